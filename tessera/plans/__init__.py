"""Domain views over the base tables, the query catalogue and its SQL twins."""


def _load() -> None:
    import importlib
    import pkgutil

    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")


def all_queries():
    from tessera.plans.catalog import QUERIES

    _load()
    return dict(QUERIES)


def all_oracles():
    from tessera.plans.catalog import ORACLES

    _load()
    return dict(ORACLES)
