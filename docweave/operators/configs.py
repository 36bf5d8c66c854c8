"""Query configurations of knowledge bases: (id, kb_id, is_default, status, is_deleted, create_time, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators.store import last_change

from docweave.functions.common import is_json

# Parameter groups that become numbers or booleans.
INTEGER_PARAMS = ["max_chunks", "max_tokens"]
NUMBER_PARAMS = ["temperature", "top_p", "frequency_penalty", "presence_penalty"]
BOOLEAN_PARAMS = ["use_reranker"]
NUMBER_TEXT = r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"


def coerce_params(params: Column) -> Column:
    """Typed struct of a map of parameter texts; what cannot be converted stays in ``rest``."""

    def text(name):
        return F.try_element_at(params, F.lit(name))

    def integer(name):
        return F.when(text(name).rlike("^[0-9]+$"), text(name).try_cast("long"))

    def number(name):
        return F.when(text(name).rlike(NUMBER_TEXT), text(name).try_cast("double"))

    def boolean(name):
        low = F.lower(text(name))
        return F.when(low == "true", True).when(low == "false", False)

    def taken(k, v):
        whole = k.isin(INTEGER_PARAMS) & v.rlike("^[0-9]+$")
        real = k.isin(NUMBER_PARAMS) & v.rlike(NUMBER_TEXT)
        flag = k.isin(BOOLEAN_PARAMS) & F.lower(v).isin("true", "false")
        return whole | real | flag

    return F.struct(
        *[integer(n).alias(n) for n in INTEGER_PARAMS],
        *[number(n).alias(n) for n in NUMBER_PARAMS],
        *[boolean(n).alias(n) for n in BOOLEAN_PARAMS],
        F.map_filter(params, lambda k, v: ~F.coalesce(taken(k, v), F.lit(False))).alias("rest"),
    )


def coerce_any(value: Column) -> Column:
    """A parameter text as JSON: whole numbers and decimals without quotes, anything else quoted."""
    quoted = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'^\{"v":([\s\S]*)\}$', 1)
    whole = F.when(value.rlike("^[0-9]+$"), value.try_cast("decimal(38,0)").cast("string"))
    real = F.when(value.rlike(NUMBER_TEXT), value.try_cast("double").cast("string"))
    return F.coalesce(whole, real, quoted)


def newest(configs: DataFrame, name: str) -> DataFrame:
    """(kb_id, <name>): newest configuration id of each base, by create time and then id."""
    last = F.max(F.struct("create_time", "id"))
    return configs.groupBy("kb_id").agg(last["id"].alias(name))


def enforce_one_default(configs: DataFrame, changed: DataFrame) -> DataFrame:
    """A base whose configurations in ``changed`` (id) became default keeps only the newest of them as default."""
    made = configs.join(changed.select("id").distinct(), "id", "left_semi").filter("is_default")
    joined = configs.join(newest(made, "_winner"), "kb_id", "left")
    flag = F.when(F.col("_winner").isNotNull(), F.col("id") == F.col("_winner")).otherwise(F.col("is_default"))
    return joined.withColumn("is_default", flag).drop("_winner")


def live(configs: DataFrame) -> DataFrame:
    return configs.filter("not is_deleted").withColumns(
        {
            "is_default": F.coalesce("is_default", F.lit(False)),
            "status": F.coalesce("status", F.lit("active")),
        }
    )


def configs_of(configs: DataFrame, kb_id=None) -> DataFrame:
    """Live configurations, newest first within a base; of one base if given."""
    out = live(configs)
    out = out if kb_id is None else out.filter(F.col("kb_id") == kb_id)
    return out.orderBy("kb_id", F.desc("create_time"), F.desc("id"))


def default_config(configs: DataFrame) -> DataFrame:
    """(kb_id, default_id): the default, live, active configuration of each base."""
    return newest(live(configs).filter("is_default and status = 'active'"), "default_id")


def resolve_config(requests: DataFrame, configs: DataFrame, any_config: bool = False) -> DataFrame:
    """(request_id, config_id): the one asked for, else the default of the base, else (if allowed) its newest."""
    usable = live(configs)
    by_id = usable.select(F.col("id").alias("config_id"), F.col("id").alias("_given"))
    out = requests.join(by_id, "config_id", "left").join(default_config(configs), "kb_id", "left")
    choices = ["_given", "default_id"]
    if any_config:
        out = out.join(newest(usable, "_any"), "kb_id", "left")
        choices.append("_any")
    return out.select("request_id", F.coalesce(*choices).alias("config_id"))


def update_config(configs: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """Only the fields that are given (not NULL) in ``changes`` (id, fields ..., maybe seq) change.

    With ``seq`` the rows of an id are applied one after the other: a field takes its value from the last row that gives
    it.  Without, one row of an id is applied, the greatest as a whole, so that no stored row is made of two changes.
    """
    if "seq" in changes.columns:
        whole = F.struct("seq", F.struct(*fields).alias("all"))
        last = [F.max_by(f, F.when(F.col(f).isNotNull(), whole)).alias(f"_{f}") for f in fields]
        given = changes.groupBy("id").agg(*last)
    else:
        given = last_change(changes, "id", fields).withColumnsRenamed({f: f"_{f}" for f in fields})
    joined = configs.join(given, "id", "left")
    return joined.withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])


def delete_config(configs: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """Soft delete; a base that loses its default gets the newest remaining live configuration as default."""
    marks = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    marked = configs.join(marks, "id", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    lost = marked.filter("_gone and is_default").select("kb_id").distinct()
    heirs = newest(marked.filter("not _gone and not is_deleted").join(lost, "kb_id", "left_semi"), "_heir")
    out = marked.join(heirs, "kb_id", "left")
    stamp = F.lit(now).cast("timestamp_ntz")
    return out.withColumns(
        {
            "is_deleted": F.col("is_deleted") | F.col("_gone"),
            "delete_time": F.when(F.col("_gone"), stamp).otherwise(F.col("delete_time")),
            "is_default": F.col("is_default") | F.coalesce(F.col("id") == F.col("_heir"), F.lit(False)),
        }
    ).drop("_gone", "_heir")


def parse_config(text: Column) -> Column:
    """JSON text as a map, empty when it is missing or does not parse."""
    parsed = F.when(is_json(text), F.from_json(text, "map<string,string>"))
    return F.coalesce(parsed, F.expr("cast(map() as map<string,string>)"))


def model_category(name: Column) -> Column:
    """Provider of a model, from its name."""
    # Name fragments and the provider each stands for.
    openai = name.contains("GPT") | name.contains("text-embedding") | name.contains("ada")
    cohere = name.contains("Cohere") | name.contains("Command") | name.contains("embed-")
    return (
        F.when(openai, "openai")
        .when(name.contains("Gemini"), "google")
        .when(cohere, "cohere")
        .when(F.lower(name).contains("vistral"), "local")
    )
