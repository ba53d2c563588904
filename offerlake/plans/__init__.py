"""Plans bind the operators to the views and name the queries."""

from importlib import import_module

MODULES = ("catalog", "attributes", "sections", "facets", "scores", "maintenance", "streams", "pages", "runs", "documents", "replays", "publishing", "markup", "records", "varied")


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
