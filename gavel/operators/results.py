"""Extraction results as data: schema checks, normalisation, names to accounts, derived summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel import lexicon as lx
from gavel.functions.text import strip

ITEM = "struct<title:string,description:string,assignee:string,deadline:string,speaker:string,quote:string,timestamp:string>"


def validate_outputs(outputs: DataFrame, column: str = "raw") -> DataFrame:
    """L1: parse one JSON result per row. `error` names a type mismatch; otherwise `summary_text`, the raw
    `items` with blank titles and non-objects dropped, and the number dropped.

    The pieces are read on their own from the JSON text, so that a wrong type in one of them is reported
    instead of turning the row into nulls.
    """
    def kind(json: Column) -> Column:
        return F.when(json.isNull() | (json == "null"), "missing").when(json.startswith("{"), "object").when(
            json.startswith("["), "array"
        ).otherwise("scalar")

    text = strip(F.col(column))
    parsed = (
        outputs.withColumn("_ok", F.try_parse_json(text).isNotNull() & text.startswith("{"))
        .withColumn("_summary", F.when(F.col("_ok"), F.get_json_object(text, "$.summary")))
        .withColumn("_items", F.when(F.col("_ok"), F.get_json_object(text, "$.action_items")))
        .withColumn("_ik", kind(F.col("_items")))
        .withColumn("_sk", kind(F.col("_summary")))
    )
    error = (
        F.when(~F.coalesce("_ok", F.lit(False)), F.lit("output must be an object"))
        .when(~F.col("_sk").isin("object", "missing"), F.lit("summary must be an object"))
        .when(~F.col("_ik").isin("array", "missing"), F.lit("action_items must be a list"))
    )
    elements = F.when(
        F.col("_ik") == "array", F.from_json("_items", "array<string>")
    ).otherwise(F.from_json(F.lit("[]"), "array<string>"))
    objects = F.transform(F.filter("_elements", lambda e: e.startswith("{")), lambda e: F.from_json(e, ITEM))
    return (
        parsed.withColumn("error", error)
        .withColumn("_elements", elements)
        .withColumn("items", F.filter(objects, lambda i: F.coalesce(strip(i["title"]), F.lit("")) != ""))
        .withColumn("n_dropped", F.size("_elements") - F.size("items"))
        .withColumn("summary_text", F.get_json_object("_summary", "$.summary_text"))
        .drop("_ok", "_summary", "_items", "_ik", "_sk", "_elements")
    )


def iso_date(text: Column) -> Column:
    """L4: an ISO date or null."""
    t = strip(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))


def usable_assignee(name: Column) -> Column:
    t = strip(name)
    return F.when(~F.lower(t).isin(lx.PLACEHOLDER_ASSIGNEES), t)


def map_item(item: Column) -> Column:
    """L2: defaults, placeholder assignees and non-ISO deadlines to null; quote columns are carried along."""
    return F.struct(
        F.coalesce(item["title"], F.lit(lx.UNTITLED)).alias("title"),
        F.coalesce(item["description"], F.lit("")).alias("description"),
        usable_assignee(item["assignee"]).alias("assignee"),
        iso_date(item["deadline"]).cast("string").alias("deadline"),
        item["speaker"].alias("speaker"),
        item["quote"].alias("quote"),
        item["timestamp"].alias("timestamp"),
    )


def map_outputs(validated: DataFrame) -> DataFrame:
    """L3: all items of all valid outputs."""
    return validated.where(F.col("error").isNull()).withColumn("items", F.transform("items", map_item))


def resolve_assignees(items: DataFrame, users: DataFrame, name: str = "assignee") -> DataFrame:
    """`assignee_id` by case-insensitive full name, else by email prefix; the smallest id on ties.

    Distinct names are resolved once, not once per item. The prefix match is an equi-join: every email offers its prefixes
    of the lengths that a name without an account has (one row, met by all users), with no limit on the length.
    """
    key = F.nullif(F.lower(strip(F.col(name))), F.lit(""))
    names = items.select(key.alias("_k")).where(F.col("_k").isNotNull()).distinct()
    by_name = users.groupBy(F.lower("full_name").alias("_k")).agg(F.min("id").alias("_by_name"))
    first = names.join(by_name, "_k", "left")
    email = F.lower("email")
    unknown = first.where(F.col("_by_name").isNull()).select("_k")
    lengths = F.broadcast(unknown.agg(F.collect_set(F.length("_k")).alias("_lengths")))
    offered = users.select("id", email.alias("_mail")).crossJoin(lengths).select(
        "id",
        F.explode(F.transform(F.filter("_lengths", lambda n: n <= F.length("_mail")), lambda n: F.substr("_mail", F.lit(1), n))).alias("_k"),
    )
    # One row per prefix before the join: partial sums make a common prefix one row, not all its users.
    best = offered.groupBy("_k").agg(F.min("id").alias("_by_email"))
    by_email = unknown.join(best, "_k")
    resolved = first.join(by_email, "_k", "left").select("_k", F.coalesce("_by_name", "_by_email").alias("assignee_id"))
    return items.withColumn("_k", key).join(resolved, "_k", "left").drop("_k")


def fallback_summary(summary: Column, titles: Column, empty_text: str | None = lx.NO_ITEMS_SUMMARY) -> Column:
    """The given summary, else a sentence from the first three titles, else the no-items text."""
    named = F.transform(F.slice(titles, 1, 3), lambda t: F.coalesce(t, F.lit(lx.UNTITLED)))
    from_titles = F.concat(
        F.lit("Meeting produced "), F.size(titles), F.lit(" action items. Key actions: "), F.array_join(named, ", "), F.lit(".")
    )
    return F.coalesce(
        F.nullif(summary, F.lit("")),
        F.when(F.coalesce(F.size(titles), F.lit(0)) > 0, from_titles),
        F.lit(empty_text if empty_text is not None else ""),
    )


def contract_of(method: Column, path: Column) -> Column:
    """The contract key of a call: an exact entry, else the first wildcard entry whose ends match."""
    call = F.concat(method, F.lit(" "), path)
    exact = [k for k in lx.RESPONSE_CONTRACTS if "*" not in k]
    out = F.when(call.isin(exact), call)
    for key in (k for k in lx.RESPONSE_CONTRACTS if "*" in k):
        head, tail = key.split("*")
        out = out.when(call.startswith(head) & call.endswith(tail), F.lit(key))
    return out


def contract_violations(responses: DataFrame) -> DataFrame:
    """`(method, path, body)` -> `violations`, an array that is empty for a sound or unlisted call."""
    body, path = F.col("body"), F.col("path")
    is_object, is_array = strip(body).startswith("{"), strip(body).startswith("[")

    def missing(json: Column, keys: list[str], label: Column) -> Column:
        absent = F.array_sort(F.array_except(F.array(*[F.lit(k) for k in keys]), F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))))
        return F.when(
            F.size(absent) > 0, F.concat(label, F.lit(": missing required keys: "), F.array_join(absent, ", "))
        )

    found = F.array().cast("array<string>")
    for key, rule in lx.RESPONSE_CONTRACTS.items():
        if rule.get("is_array"):
            checks = [F.when(~is_array, F.concat(path, F.lit(": expected array")))]
        else:
            checks = [
                F.when(~is_object, F.concat(path, F.lit(": expected object"))).otherwise(
                    missing(body, rule["required_keys"], path)
                )
            ]
            for name, keys in rule.get("nested", {}).items():
                inner = F.get_json_object(body, f"$.{name}")
                label = F.concat(path, F.lit(f".{name}"))
                checks.append(
                    F.when(
                        is_object & inner.isNotNull(),
                        F.when(~inner.startswith("{"), F.concat(label, F.lit(": expected object"))).otherwise(
                            missing(inner, keys, label)
                        ),
                    )
                )
        found = F.when(F.col("_contract") == key, F.array_compact(F.array(*checks))).otherwise(found)
    return responses.withColumn("_contract", contract_of(F.col("method"), path)).withColumn("violations", found).drop("_contract")
