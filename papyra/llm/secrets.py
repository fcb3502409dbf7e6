"""Secret scan: candidates by one pattern, false positives removed by a random forest.  Column expressions only.

A candidate is a run of 16 or more token characters that holds a digit or stands after an assignment, or a value of any
length without white space that is assigned to a secret-like name.  '=' belongs to a run only as its padding: of
NAME=value the name stays in the text to the left.  The texts between candidates give its neighbouring words (a candidate
that another is assigned to is that one's name, and kept in its text to the left).  Features: length, entropy and share of distinct characters, shares of character
kinds, transitions between kinds, repeats, dictionary coverage (share of the candidate's letters in words that the whole
corpus uses often), path (depth, and whether it looks like a test, example or documentation), neighbouring words
(secret-like names, assignment, quotes, words that speak of examples), and the length of the previous word.

The forest is trained on labelled findings: any table with the feature columns and a label.  Where none is given,
findings are labelled by rules that a reviewer would state (``reviewed``): known credential formats and values assigned
to a secret-like name are secrets; long numbers, addresses, repeated characters, plain words and placeholders are not;
what no rule decides is left out of the training, and scored.  The labelled sample is bounded (``max_train``).

Edge cases: null and empty texts have no candidates; without findings of both labels the score of every candidate is
the share of secrets among the findings (0 without any); a null path counts as empty; repeated rows are scanned one by
one (their candidates are numbered alike); extra columns are left behind; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import stage

MAX_TRAIN = 20_000        # documented bound of the labelled findings
TREES, DEPTH, SEED = 40, 8, 11
COMMON = 5                # occurrences in the corpus from which a word belongs to the dictionary
AROUND = 80               # characters of text on each side that count as the neighbourhood
THRESHOLD = 0.5

# What a candidate looks like, and the words that its neighbourhood is searched for.
NAMES = "(?i:token|secret|passw|pwd|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key|bearer)"
TOKEN = "[A-Za-z0-9+/_.\\-]"
RUN = f"{TOKEN}{{16,}}+(?:={{1,2}}(?![A-Za-z0-9+/_=.\\-\"']))?+(?!=)"
VALUE = "[^\\s\"'`,;&<>(){}\\[\\]:=][^\\s\"'`,;&<>(){}\\[\\]]*+"
CANDIDATE = (f"(?<=[:=]\\s{{0,2}}[\"']?)(?<={NAMES}[A-Za-z0-9_-]{{0,32}}[\"']?\\s{{0,2}}[:=]{{1,2}}\\s{{0,2}}[\"']?){VALUE}"
             f"|(?<!{TOKEN})(?=[A-Za-z+/_.\\-]*[0-9]){RUN}|(?<=[:=] ?[\"']?){RUN}")
ASSIGNED = "[:=]\\s*[\"']?$"
WORD = "\\p{L}{3,}+"
HINTS = "(?i)(example|sample|dummy|placeholder|test|changeme|xxxx|your[_-])"
FORMATS = ("(?<![A-Za-z0-9])(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk[-_][A-Za-z0-9_-]{20,}"
           "|eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\..*|AIza[0-9A-Za-z_-]{35})(?![A-Za-z0-9])")
# Repeated groups are possessive: those are matched in a loop, so a candidate of any length needs no deep stack.
PLAIN = "^([0-9.+/_=-]+|[A-Za-z]+[.]?|.*(.)\\2{7,}.*|[A-Za-z]++(?:[-_./][A-Za-z]++)++)$"
MAIL = "^[\\w.+-]+@[\\w-]++(?:[.][\\w-]++)++$"

FEATURES = ["n", "distinct", "entropy", "digits", "uppers", "lowers", "others", "hexes", "shifts", "repeats", "coverage",
            "depth", "path_hint", "named", "assigned", "quoted", "hinted", "left_len", "at_line_start", "dotted"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(doc_id, nth, start, candidate, left, right, path): the candidates with what stands on either side."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("doc_id"), path.alias("path"), text.alias("text"))
    found = (rows.withColumn("found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
             .filter(F.size("found") > 0)
             .withColumn("gaps", F.split("text", CANDIDATE, -1)))
    # Running start of each candidate: lengths of the gaps and candidates before it, kept in one pass.
    lengths = F.aggregate(
        F.sequence(F.lit(0), F.size("found") - 1),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts")),
        lambda acc, i: F.struct(
            (acc["at"] + F.length(F.get("gaps", i)) + F.length(F.get("found", i))).alias("at"),
            F.array_append(acc["starts"], acc["at"] + F.length(F.get("gaps", i))).alias("starts")),
        lambda acc: acc["starts"])
    gap = lambda i: F.get("gaps", i)                                                          # noqa: E731
    name = lambda i: F.when(gap(i).rlike("^[\"']?\\s*[:=]"), F.get("found", i - 1))           # noqa: E731
    sides = F.transform(F.col("found"), lambda c, i: F.struct(
        c.alias("candidate"), F.right(F.concat(F.coalesce(name(i), F.lit("")), gap(i)), F.lit(AROUND)).alias("left"),
        F.left(F.get("gaps", i + 1), F.lit(AROUND)).alias("right")))
    return (found.select("doc_id", "path", F.posexplode(F.arrays_zip(sides.alias("s"), lengths.alias("starts"))).alias("nth", "z"))
            .select("doc_id", "path", F.col("nth").cast("long").alias("nth"), F.col("z.starts").alias("start"), "z.s.*"))


def _share(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)) / F.length(c)


def _entropy(c: Column) -> Column:
    n = F.length(c)
    counts = F.transform(F.array_distinct(F.split(c, "")), lambda x: F.when(
        F.length(x) > 0, (n - F.length(F.replace(c, x, F.lit("")))) / n).otherwise(F.lit(0.0)))
    return F.aggregate(counts, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0)))


def dictionary(docs: DataFrame, text_col: str = "text", at_least: int = COMMON) -> DataFrame:
    """The lower-case words of three or more letters that occur often in the whole corpus; any other character ends a word."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0))
    return (docs.select(F.explode(words).alias("word"))
            .groupBy("word").count().filter(F.col("count") >= at_least).select("word"))


def coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """(candidate, coverage): letters of a distinct candidate in dictionary words, as a share of its length."""
    runs = found.select("candidate").distinct().select(
        "candidate", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit(WORD), F.lit(0))).alias("word"))
    known = runs.join(words, "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("letters"))
    return known.select("candidate", (F.col("letters") / F.length("candidate")).alias("coverage"))


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    c, left, right = F.col("candidate"), F.col("left"), F.col("right")
    cov = coverage(found, words).withColumnsRenamed({"candidate": "c_candidate"})
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")                               # noqa: E731
    near = F.right(left, F.lit(32))
    return found.join(cov, found.candidate == F.col("c_candidate"), "left").select(
        *found.columns, F.length(c).cast("double").alias("n"),
        (F.size(F.array_distinct(F.split(c, ""))) / F.length(c)).alias("distinct"), _entropy(c).alias("entropy"),
        _share(c, "[0-9]").alias("digits"), _share(c, "[A-Z]").alias("uppers"), _share(c, "[a-z]").alias("lowers"),
        _share(c, "[^A-Za-z0-9]").alias("others"), _share(c, "[0-9a-fA-F]").alias("hexes"),
        _share(c, "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])").alias("shifts"),
        _share(c, "(.)(?=\\1)").alias("repeats"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.regexp_count("path", F.lit("/")).cast("double").alias("depth"),
        flag(F.col("path").rlike("(?i)(test|example|sample|mock|fixture|doc)")).alias("path_hint"),
        flag(near.rlike(NAMES)).alias("named"), flag(left.rlike(ASSIGNED)).alias("assigned"),
        flag(left.rlike("[\"']$") & right.rlike("^[\"']")).alias("quoted"),
        flag(F.concat(left, F.lit(" "), c, F.lit(" "), right).rlike(HINTS)).alias("hinted"),
        F.length(F.regexp_extract(left, "(\\S*)\\s*$", 1)).cast("double").alias("left_len"),
        flag(left.rlike("\\n\\s*$")).alias("at_line_start"), _share(c, "[.]").alias("dotted"))


def reviewed(found: DataFrame) -> Column:
    """A label for a finding by stated rules (1 secret, 0 not), null where no rule decides."""
    c = F.col("candidate")
    hint = F.concat("left", F.lit(" "), c).rlike(HINTS)
    return (F.when(c.rlike(PLAIN) | c.rlike(MAIL) | F.col("right").rlike("^@"), 0)
            .when(c.rlike(FORMATS) & ~hint, 1).when(hint, 0)
            .when(F.right("left", F.lit(32)).rlike(NAMES + "[A-Za-z0-9_-]*[\"']?\\s*" + ASSIGNED), 1)
            .when(F.col("right").rlike("^\\s*[(@]"), 0))


def train(findings: DataFrame, max_train: int = MAX_TRAIN):
    """A forest from findings (feature columns and ``label``), or the share of secrets where only one label occurs."""
    sample = stage(findings.filter(F.col("label").isNotNull()).orderBy(
        F.xxhash64("candidate", "doc_id", "nth"), "doc_id", "nth").limit(max_train)
        .select(*FEATURES, F.col("label").cast("double").alias("label")), "findings")
    seen = sample.agg(F.avg("label").alias("share"), F.countDistinct("label").alias("kinds")).first()
    if (seen["kinds"] or 0) < 2:
        return float(seen["share"] or 0.0)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="x", labelCol="label",
                                    minInstancesPerNode=2)
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(sample))


def score(found: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """``found`` with score (probability of a secret) and is_secret."""
    if isinstance(model, float):
        out = found.withColumn("score", F.lit(model))
    else:
        x = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(found)
        out = model.transform(x).withColumn("score", vector_to_array("probability")[1])
    return out.withColumn("is_secret", F.col("score") >= threshold)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source",
         findings: DataFrame | None = None, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per candidate: doc_id, nth, start, length, candidate_sha256, score, is_secret."""
    found = stage(candidates(docs, id_col, text_col, path_col), "candidates")
    described = stage(features(found, dictionary(docs, text_col)), "described")
    labelled = described.withColumn("label", reviewed(described)) if findings is None else findings
    return score(described, train(labelled, max_train)).select(
        "doc_id", "nth", "start", F.length("candidate").cast("long").alias("length"),
        F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")
