"""Registering a query together with its oracle."""


def registrar(queries: dict, oracles: dict):
    def check(name, sql=None):
        def register(fn):
            queries[name] = fn
            if sql is not None:
                oracles[name] = sql
            return fn

        return register

    return check
