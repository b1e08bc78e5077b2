import importlib

NAMES = ["pieces", "rows", "recipes", "signals", "events", "inspection", "stateful", "pixels", "extension", "streaming"]


def import_all() -> None:
    for name in NAMES:
        importlib.import_module(f"linewatch.queries.{name}")
