import hashlib
import os

import pytest
from pyspark.sql import functions as F

from papyra.operators import documents as doc
from papyra.sources.files import binary_scan, file_inventory


@pytest.fixture()
def raw_dir(scratch):
    files = {
        "good.txt": "linha um\nlinha dois".encode(),
        "bad.txt": b"\xff\xfe\x00abc",
        "copy1.pdf": b"same bytes",
        "copy2.PDF": b"same bytes",
        "noext": b"plain",
        "a_b%c.pdf": b"odd name",
        ".hidden": b"dot",
    }
    for n, b in files.items():
        with open(os.path.join(scratch, n), "wb") as f:
            f.write(b)
    os.makedirs(os.path.join(scratch, "sub.d"))
    with open(os.path.join(scratch, "sub.d", "inner.pdf"), "wb") as f:
        f.write(b"nested")
    # a nested folder whose path ends like the listed one must not leak into the listing
    same = os.path.join(scratch, "sub.d", os.path.basename(scratch))
    os.makedirs(same)
    with open(os.path.join(same, "deep.pdf"), "wb") as f:
        f.write(b"deep")
    return scratch, files


def test_inventory_hashes_names_and_types(spark, raw_dir):
    d, files = raw_dir
    rows = {r.file_name: r for r in file_inventory(spark, d).collect()}
    # not recursive; Spark's file index skips hidden names (leading '.' or '_')
    visible = {n: b for n, b in files.items() if not n.startswith(".")}
    assert set(rows) == set(visible)
    for n, b in visible.items():
        assert rows[n].file_hash == hashlib.md5(b).hexdigest()
        assert rows[n].size == len(b)
    assert rows["copy2.PDF"].type == "pdf" and rows["noext"].type == ""
    assert rows["a_b%c.pdf"].type == "pdf"


def test_listing_projection_does_not_read_content(spark, raw_dir):
    d, _ = raw_dir
    plan = binary_scan(spark, d).select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_route_and_raw_decode(spark, raw_dir):
    d, _ = raw_dir
    routed = doc.route_by_extension(binary_scan(spark, d, recursive=True))
    routes = {os.path.basename(r.path): r.route for r in routed.collect()}
    assert routes["copy2.PDF"] == "parse" and routes["noext"] == "raw" and routes["inner.pdf"] == "parse"
    raw = {os.path.basename(r.path): r for r in doc.raw_text_documents(routed).collect()}
    assert raw["good.txt"].text == "linha um\nlinha dois" and raw["good.txt"].error_status is None
    assert raw["bad.txt"].text is None and raw["bad.txt"].error_status == "INVALID_UTF8"


def test_outcomes_cover_every_file(spark, raw_dir):
    d, files = raw_dir
    batch = binary_scan(spark, d, recursive=True).select("path", "content")
    out = doc.process_batch(batch, doc.text_parser)
    rep = {r.outcome: r.n_files for r in doc.coverage_report(batch, out).collect()}
    assert sum(rep.values()) == len([n for n in files if not n.startswith(".")]) + 2


def _parsed(spark, rows):
    return spark.createDataFrame(rows, "path string, j string").select("path", F.parse_json("j").alias("parsed"))


def test_variant_shapes(spark):
    p = _parsed(spark, [
        ("pages", '{"metadata":{"version":"1.0"},"document":{"pages":[{"content":"a"},{"content":"b"}],'
                  '"elements":[{"content":"x"}]}}'),
        ("numver", '{"metadata":{"version":1.0},"document":{"pages":[{"content":"p"}],"elements":[{"content":"e"}]}}'),
        ("nodoc", '{"metadata":{"version":"2.0"}}'),
        ("empty", '{"metadata":{"version":"2.0"},"document":{"elements":[]}}'),
        ("nulls", '{"metadata":{"version":"2.0"},"document":{"elements":[{"content":null},{}]}}'),
        ("err", '{"metadata":{},"error_status":"BAD"}'),
    ])
    text = {r.path: r.text for r in doc.concat_text(p).collect()}
    assert text == {"pages": "a\n\nb", "numver": "e"}  # a JSON number 1.0 is not the text '1.0'
    assert [r.path for r in doc.parse_errors(p).collect()] == ["err"]
    via_rows = {r.path: r.text for r in doc.concat_elements(doc.explode_elements(p)).collect()}
    assert via_rows == text


def test_pandas_parser_isolates_failures(spark):
    def parse(b: bytes) -> dict:
        if b.startswith(b"X"):
            raise ValueError("boom")
        return {"metadata": {"version": "2.0"}, "document": {"elements": [{"content": b.decode()}]}}
    df = spark.createDataFrame([("a.pdf", bytearray(b"hello")), ("b.pdf", bytearray(b"Xbad"))],
                               "path string, content binary")
    out = {r.path: r for r in doc.pandas_parser(parse)(df).select(
        "path", doc.error_of(F.col("parsed")).alias("e"), doc.reassembled_text(F.col("parsed")).alias("t")).collect()}
    assert out["a.pdf"].t == "hello" and out["a.pdf"].e is None
    assert out["b.pdf"].e.startswith("PARSE_FAILED")


def test_topn_on_paths(spark):
    df = spark.createDataFrame([(f"/p/{i:03d}", bytearray(b"x")) for i in range(50)], "path string, content binary")
    assert [r.path for r in doc.batch_topn_files(df, 5).orderBy("path").collect()] == [f"/p/{i:03d}" for i in range(5)]


def test_single_pass_outcomes_parse_once_without_staging(spark, raw_dir, scratch):
    import uuid
    d, _ = raw_dir
    calls = os.path.join(scratch, "calls")
    os.makedirs(calls)

    def parse(b: bytes) -> dict:
        with open(os.path.join(calls, uuid.uuid4().hex), "w") as f:
            f.write("x")
        if b == b"odd name":
            raise ValueError("bad")
        return {"metadata": {"version": "2.0"}, "document": {"elements": [{"content": "c"}]}}

    batch = binary_scan(spark, d, recursive=True).select("path", "content")
    out = doc.process_batch(batch, doc.pandas_parser(parse)).collect()
    n_parse = sum(1 for r in doc.route_by_extension(batch).collect() if r.route == "parse")
    assert len(os.listdir(calls)) == n_parse
    errors = sorted(r.error_status.split(":")[0] for r in out if r.error_status is not None)
    assert errors == ["INVALID_UTF8", "PARSE_FAILED"]  # the undecodable raw file and the parser failure


HTML = [
    ("<h1 class='a>b'>A &amp; B</h1>\n<h2>C</h2><p>one\n two<br>three <b>bold</b></p>", ["A & B", "C", "one two\nthree bold"]),
    ("<ul><li>1<li>2 <i>x</i></ul><ol><li>3</li></ol>", ["1", "2 x", "3"]),
    ("<table><tr><td>a</td><td> b</td></tr><tr><th>c<th>d</table>", ["a\tb", "c\td"]),
    ("<pre>x  y\n <b>z</b></pre>after", ["x  y\n z", "after"]),
    ("&#233;&#x1F600;&copy;&nope;&apos;&lt;p&gt;&#55296;&#0;", ["é😀©&nope;'<p>��"]),
    ("<head><title>t</title></head><body><!-- <p>no</p> --><script>var t='</p>'</script><div>yes</div><p>open <b>x", ["yes", "open x"]),
    ("a < b and c > d", ["a < b and c > d"]), ("plain", ["plain"]), ("", []), (None, None), ("<p></p><div> </div>", []),
    ("<P>Upper</P><p \">odd", ["Upper", "odd"]), ("<!doctype html><?xml v?><p>ok", ["ok"]),
]


def test_html_blocks(spark):
    from papyra.functions.html import html_blocks
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(HTML)], "i int, h string")
    got = {r.i: r.b for r in df.select("i", html_blocks(F.col("h")).alias("b")).collect()}
    assert [got[i] for i in range(len(HTML))] == [b for _, b in HTML]


def test_html_of_any_length_needs_no_deep_stack(spark):
    from papyra.functions.html import html_blocks
    long = ["<p " + "a='x' " * 100_000 + ">end", "<" * 20_000 + "x", "<p>" + "<i>z</i>" * 50_000, "<p>x</p>" * 20_000,
            "<!--" + "-" * 300_000, "&amp;" * 50_000, "<p>" + "<li><ul>" * 20_000 + "deep"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(long)], "i int, h string")
    got = {r.i: r.b for r in df.select("i", html_blocks(F.col("h")).alias("b")).collect()}
    assert got[0] == ["end"] and len(got[1][0]) == 20_001 and got[2] == ["z" * 50_000] and len(got[3]) == 20_000
    assert got[4] == [] and got[5] == ["&" * 50_000] and got[6] == ["deep"]


def test_every_parser_hands_other_columns_on(spark):
    from papyra.functions.model import parse_lines
    df = spark.createDataFrame([("a.pdf", bytearray(b"x\ny!"), "h", 4)], "path string, content binary, file_hash string, length int")
    for parser in (doc.text_parser, doc.html_parser, doc.pandas_parser(parse_lines)):
        out = parser(df)
        assert out.columns == ["path", "file_hash", "length", "parsed"]
        assert out.select("path", "file_hash", "length").collect() == [("a.pdf", "h", 4)]


def test_pandas_parser_hands_results_on_by_size(spark):
    """A worker holds about 4 MB of results, not those of a whole batch of rows."""
    import pyarrow as pa

    class Held:
        schema = spark.createDataFrame([], "path string, content binary").schema
        columns = ["path", "content"]

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            self.run = run
            return self
    held = Held()
    doc.pandas_parser(lambda b: {"text": "x" * 1_000_000})(held)
    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(20)], "content": [b"a"] * 19 + [None]})
    out = [*held.run(iter([batch]))]
    assert len(out) > 3 and all(sum(len(x) for x in b.column("parsed_json").to_pylist()) < 6_000_000 for b in out)
    assert [x for b in out for x in b.column("path").to_pylist()] == [str(i) for i in range(20)]
    assert out[-1].column("parsed_json")[-1].as_py() == '{"error_status": "EMPTY"}'
    assert [*held.run(iter([batch.slice(0, 0)]))] == []


def test_a_worker_unpacks_the_prompts_of_one_request():
    import pyarrow as pa

    from papyra.functions.model import _call_batches, md5_model
    batch = pa.RecordBatch.from_pydict({"p": [str(i) for i in range(10)], "k": list("abcdefghij")})
    out = [*_call_batches(md5_model, "p", "k", 4)(iter([batch]))]
    assert [b.num_rows for b in out] == [4, 4, 2]
    assert [x for b in out for x in b.column("response").to_pylist()] == md5_model([str(i) for i in range(10)])
    assert [x for b in out for x in b.column("k").to_pylist()] == list("abcdefghij")
