"""Stand-in models for the command-line test (shipped to executors with addPyFile)."""


def extract_stub(prompts):
    return ['{"tipo_contrato": "Locação", "valor_total": 12.5}' for _ in prompts]


def summary_stub(prompts):
    return ["resumo do contrato" for _ in prompts]
