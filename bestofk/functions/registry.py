"""Default parameters of the studies and reports. All of them are arguments of the functions that use them."""

# Per-dataset sample count, prompt count and token cap of each panel.
MAIN_PANEL = [
    {"dataset": "gsm8k", "k": 64, "m": 1319, "max_tokens": 1024},
    {"dataset": "math", "k": 64, "m": 1000, "max_tokens": 1024},
    {"dataset": "humaneval", "k": 64, "m": 164, "max_tokens": 1024},
    {"dataset": "matharena", "k": 64, "m": 60, "max_tokens": 1024},
    {"dataset": "livecodebench", "k": 64, "m": 75, "max_tokens": 1024},
    {"dataset": "ultrafeedback", "k": 32, "m": 1000, "max_tokens": 512},
    {"dataset": "alpaca_eval", "k": 32, "m": 300, "max_tokens": 512},
]
INFERENCE_PANEL = [
    {"dataset": "gsm8k", "k": 64, "m": 500, "max_tokens": 1024},
    {"dataset": "math", "k": 64, "m": 500, "max_tokens": 1024},
    {"dataset": "humaneval", "k": 64, "m": 164, "max_tokens": 1024},
    {"dataset": "matharena", "k": 64, "m": 60, "max_tokens": 1024},
    {"dataset": "livecodebench", "k": 64, "m": 75, "max_tokens": 1024},
    {"dataset": "ultrafeedback", "k": 32, "m": 500, "max_tokens": 512},
    {"dataset": "alpaca_eval", "k": 32, "m": 300, "max_tokens": 512},
]
LENGTH_PANEL = [
    {"dataset": "gsm8k", "k": 64, "m": 500, "max_tokens": 64},
    {"dataset": "math", "k": 64, "m": 500, "max_tokens": 64},
    {"dataset": "matharena", "k": 64, "m": 60, "max_tokens": 64},
    {"dataset": "bbh", "k": 64, "m": 480, "max_tokens": 64},
]
TEMPERATURES = [0.0, 0.7, 1.0]
VOTE_SIZES = [2, 4, 8, 16, 32]
VOTE_DATASETS = ["gsm8k", "math", "matharena"]
LENGTHS = [0, 64, 128, 256, 512, 1024, 2048]

# Stand-ins for report cells that exist under another name only.
MODEL_ALIASES = {"qwen2.5-72b-instruct": ["qwen2.5-72b-instruct-awq"]}
DATASET_ALIASES = {
    ("qwen2.5-72b-instruct", "ultrafeedback_judge-qwen2.5-14b-instruct"): "ultrafeedback_judge-deepseek-v4-flash",
    ("qwen2.5-72b-instruct", "alpaca_eval_judge-qwen2.5-14b-instruct"): "alpaca_eval_judge-deepseek-v4-flash",
}


def settings(procedure: str, values, datasets=None) -> list[dict]:
    """Rows (procedure, value) for a work grid, limited to ``datasets`` where given."""
    limit = {} if datasets is None else {"datasets": list(datasets)}
    return [{"procedure": procedure, "value": float(v), **limit} for v in values]
