"""Query plans composed of the library's operators."""


def all_queries():
    from tessera.plans import calibration_queries, catalogue, field_queries, model_queries, product_queries, risk_queries, space_queries, stat_queries, stream_queries, text_queries, time_queries  # noqa: F401

    return catalogue.QUERIES


def all_sql():
    all_queries()
    from tessera.plans import catalogue

    return catalogue.SQL
