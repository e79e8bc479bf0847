"""Quality flags of answers, by checks that are rows of a table.

A rule is (scenario, flag, kind, field, args): in an answer to the scenario the flag says whether the check of that kind holds. args
is a list of groups of alternatives. Answers have scenario, response, sources (type, path, bucket, tenant, features, metadata), facts
(a map of text by name, such as hints.metric_intent) and lists (a map of lists by name). All checks of an answer are
evaluated in one pass over the rules of its scenario, which a join brings to it as one list.

A missing fact, list or response never satisfies a check but `fact_is_not`, `response_lacks`, `list_lacks` and the like, which ask
for absence. Texts are compared in lower case, names and ids as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as words
from ..functions import text

RULE = "scenario string, flag string, kind string, field string, args array<array<string>>"
SOURCES = "array<struct<type:string,path:string,bucket:string,tenant:string,features:array<string>,metadata:map<string,string>>>"
ANSWER = f"scenario string, response string, sources {SOURCES}, facts map<string,string>, lists map<string,array<string>>"
#: Rules of this scenario hold for every answer.
EVERY = "*"

_NONE = "array<string>"


def _none() -> Column:
    return F.array().cast(_NONE)


def _groups(value: Column, args: Column) -> Column:
    """Each group has an alternative that stands in the text."""
    return F.forall(args, lambda g: F.exists(g, lambda a: F.contains(value, F.lower(a))))


def _any(value: Column, args: Column) -> Column:
    return F.exists(F.flatten(args), lambda a: F.contains(value, F.lower(a)))


def _known(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def _number(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def _checks() -> dict[str, Callable[[Column], Column]]:
    """What each kind asks of an answer's row, with the rule r."""
    response, sources = F.col("_response"), F.col("_sources")
    fact = lambda r: F.try_element_at("_facts", r["field"])
    listed = lambda r: F.coalesce(F.try_element_at("_lists", r["field"]), _none())
    first = lambda r: F.coalesce(F.try_element_at(r["args"], F.lit(1)), _none())
    second = lambda r: F.coalesce(F.try_element_at(r["args"], F.lit(2)), _none())
    among = lambda r: F.filter(sources, lambda s: F.array_contains(first(r), s["type"]))
    meta = lambda r, s: F.try_element_at(s["metadata"], r["field"])
    buckets, tenants = _known(F.transform(sources, lambda s: s["bucket"])), _known(F.transform(sources, lambda s: s["tenant"]))
    same = lambda a, b: (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    return {
        "response_filled": lambda r: F.regexp_like(response, F.lit(r"(?U)\S")),
        "response_has": lambda r: _groups(response, r["args"]),
        "response_has_any": lambda r: _any(response, r["args"]),
        "response_lacks": lambda r: ~_any(response, r["args"]),
        "response_numbers": lambda r: F.forall(r["args"], lambda g: F.exists(g, lambda a: F.array_contains("_numbers", text.numeric_normal_form(a)))),
        "response_value": lambda r: F.exists(F.flatten(r["args"]), lambda a: F.contains(response, F.lower(a)) | F.coalesce(F.array_contains("_numbers", text.numeric_normal_form(a)), F.lit(False))),
        "fact_filled": lambda r: text.strip(fact(r)) != "",
        "fact_is": lambda r: F.array_contains(F.flatten(r["args"]), fact(r)),
        "fact_is_not": lambda r: ~F.coalesce(F.array_contains(F.flatten(r["args"]), fact(r)), F.lit(False)),
        "fact_above": lambda r: _number(fact(r)) > _number(F.try_element_at(first(r), F.lit(1))),
        "fact_within": lambda r: _number(fact(r)) <= _number(F.try_element_at("_facts", F.try_element_at(first(r), F.lit(1)))),
        "list_has": lambda r: F.forall(r["args"], lambda g: F.arrays_overlap(listed(r), g)),
        "list_lacks": lambda r: ~F.arrays_overlap(_known(listed(r)), F.flatten(r["args"])),
        "list_is": lambda r: same(_known(listed(r)), _known(first(r))),
        "feature": lambda r: F.exists(
            F.flatten(r["args"]),
            lambda a: F.exists(F.map_values("_lists"), lambda v: F.coalesce(F.array_contains(v, a), F.lit(False))) | F.exists(sources, lambda s: F.coalesce(F.array_contains(s["features"], a), F.lit(False))) | F.contains(F.lower(F.coalesce(fact(r), F.lit(""))), a),
        ),
        "sources_any": lambda r: F.size(sources) > 0,
        "source_types": lambda r: F.forall(r["args"], lambda g: F.exists(sources, lambda s: F.array_contains(g, s["type"]))),
        "source_path_ends": lambda r: F.exists(among(r), lambda s: F.exists(second(r), lambda a: F.endswith(s["path"], a))),
        "source_buckets_known": lambda r: F.exists(among(r), lambda s: F.coalesce(s["bucket"], F.lit("")) != ""),
        "source_meta_filled": lambda r: F.exists(among(r), lambda s: F.coalesce(meta(r, s), F.lit("")) != ""),
        "source_meta_is": lambda r: F.exists(among(r), lambda s: F.coalesce(F.array_contains(second(r), meta(r, s)), F.lit(False))),
        "source_meta_starts": lambda r: F.exists(among(r), lambda s: F.exists(second(r), lambda a: F.coalesce(F.startswith(meta(r, s), a), F.lit(False)))),
        "source_meta_has": lambda r: F.exists(among(r), lambda s: _groups(F.lower(F.coalesce(meta(r, s), F.lit(""))), F.slice(r["args"], 2, 1_000))),
        "buckets_known": lambda r: F.size(buckets) > 0,
        "buckets_within": lambda r: (F.size(sources) > 0) & (F.size(F.array_except(buckets, F.flatten(r["args"]))) == 0),
        "buckets_without": lambda r: ~F.arrays_overlap(_known(F.transform(F.filter(sources, lambda s: (F.coalesce(r["field"], F.lit("")) == "") | (s["type"] == r["field"])), lambda s: s["bucket"])), F.flatten(r["args"])),
        "tenants_are": lambda r: same(tenants, _known(first(r))),
    }


#: The kinds of checks; `all_of` asks for other flags of the same answer, named in its args.
KINDS = (
    "response_filled", "response_has", "response_has_any", "response_lacks", "response_numbers", "response_value", "fact_filled", "fact_is", "fact_is_not", "fact_above", "fact_within", "list_has", "list_lacks", "list_is", "feature",
    "sources_any", "source_types", "source_path_ends", "source_buckets_known", "source_meta_filled", "source_meta_is", "source_meta_starts", "source_meta_has", "buckets_known", "buckets_within", "buckets_without", "tenants_are", "all_of",
)
#: The kinds that look at the numbers in an answer.
NUMERIC = ("response_numbers", "response_value")


def flagged(answers: DataFrame, rules: DataFrame, out: str = "flags") -> DataFrame:
    """Adds a map of flags to each answer: those of its scenario's rules and of the rules of EVERY. An unknown kind raises; of
    several rules of one flag all must hold."""
    unknown = F.raise_error(F.concat(F.lit("unknown kind of check: "), F.col("kind"))).cast("string")
    known = rules.select("scenario", F.struct("flag", F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(unknown).alias("kind"), "field", F.coalesce("args", F.array().cast("array<array<string>>")).alias("args")).alias("r"))
    listed = known.groupBy("scenario").agg(F.collect_list("r").alias("_rules"))  # as many as a scenario has
    every = known.where(F.col("scenario") == EVERY).agg(F.collect_list("r").alias("_every"))  # one row
    # a table that people write, so answers stay where they are; by the scenarios they would be a few tasks'
    rows = answers.join(F.broadcast(listed.withColumnRenamed("scenario", "_scenario").where(F.col("_scenario") != EVERY)), F.col("scenario") == F.col("_scenario"), "left").join(F.broadcast(every))
    response = F.lower(F.coalesce("response", F.lit("")))
    rows = rows.withColumns({"_response": response, "_sources": F.coalesce("sources", F.array().cast(SOURCES)), "_facts": F.coalesce("facts", F.create_map().cast("map<string,string>")), "_lists": F.coalesce("lists", F.create_map().cast("map<string,array<string>>"))})
    checks = _checks()

    def holds(r: Column) -> Column:
        found = F.lit(False)
        for kind, check in checks.items():
            found = F.when(r["kind"] == kind, F.coalesce(check(r), F.lit(False))).otherwise(found)
        return found

    asked = F.concat(F.coalesce("_rules", F.array().cast(listed.schema["_rules"].dataType)), F.col("_every"))
    judged = F.transform(F.filter("_asked", lambda r: r["kind"] != "all_of"), lambda r: F.struct(r["flag"].alias("flag"), holds(r).alias("ok")))
    # only answers that are asked for numbers are searched for them
    numbers = F.filter(words.numbers_in(F.col("_response")), lambda n: n.isNotNull())
    rows = rows.withColumn("_asked", asked)
    rows = rows.withColumn("_numbers", F.when(F.exists("_asked", lambda r: r["kind"].isin(*NUMERIC)), numbers).otherwise(_none()))
    rows = rows.withColumn("_judged", judged)
    failed = F.transform(F.filter("_judged", lambda j: ~j["ok"]), lambda j: j["flag"])
    names = F.array_distinct(F.transform("_judged", lambda j: j["flag"]))
    rows = rows.withColumns({"_failed": failed, "_names": names})
    ok = lambda flag: F.array_contains("_names", flag) & ~F.array_contains("_failed", flag)
    plain = F.transform("_names", lambda n: F.struct(n.alias("key"), (~F.array_contains("_failed", n)).alias("value")))
    both = F.transform(F.filter("_asked", lambda r: r["kind"] == "all_of"), lambda r: F.struct(r["flag"].alias("key"), F.forall(F.flatten(r["args"]), ok).alias("value")))
    return rows.withColumn(out, F.map_from_entries(F.concat(plain, both))).select(*answers.columns, out)
