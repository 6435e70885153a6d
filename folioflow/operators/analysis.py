"""Filter descriptions and Java sources as tables: validation, normal form, evidence, coverage. Catalyst only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The shape of a filter description and the words that it may use.
IR = (
    "name string, version string, mime_types array<string>, extensions array<string>, features array<string>, parameters array<string>, "
    "parameter_rules array<struct<name:string,value_type:string,default:string>>, "
    "token_rules array<struct<token_type:string,code_type:string,tag_strategy:string,translatable:boolean>>, used_parameters array<string>"
)
VALUE_TYPES, STRATEGIES = ("boolean", "string", "integer", "pattern"), ("isolated", "paired", "document_part", "text")
LISTS = ("mime_types", "extensions", "features", "parameters", "parameter_rules", "token_rules", "used_parameters")


def read_ir(rows: DataFrame, column: str = "value") -> DataFrame:
    """Descriptions from JSON text beside the other columns; lists that are not there are empty."""
    ir = rows.withColumn("_ir", F.from_json(column, IR))
    kinds = dict(ir.select("_ir.*").dtypes)
    empty = lambda c: F.coalesce(F.col(f"_ir.{c}"), F.array().cast(kinds[c])).alias(c)
    return ir.select(*[c for c in rows.columns if c != column], "_ir.name", "_ir.version", *[empty(c) for c in LISTS])


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def ir_faults(ir: DataFrame) -> DataFrame:
    """Adds faults: what is wrong with each description, in the order of the checks; none for a valid one."""
    names = F.transform("parameter_rules", lambda r: r["name"])
    checks = [
        ("name", blank(F.col("name"))),
        ("version", blank(F.col("version"))),
        ("mime_types", F.size("mime_types") == 0),
        ("extensions", F.size("extensions") == 0),
        ("extension_dot", F.exists("extensions", lambda x: ~x.startswith("."))),
        ("features", F.size("features") == 0),
        ("parameter_twice", F.size(F.array_distinct(names)) < F.size(names)),
        ("parameter_undeclared", (F.size("parameters") > 0) & (F.size(F.array_except(names, "parameters")) > 0)),
        ("parameter_name", F.exists(names, blank)),
        ("parameter_type", F.exists("parameter_rules", lambda r: ~F.coalesce(r["value_type"], F.lit("")).isin(*VALUE_TYPES))),
        ("token_type", F.exists("token_rules", lambda r: blank(r["token_type"]) | blank(r["code_type"]))),
        ("token_strategy", F.exists("token_rules", lambda r: ~F.coalesce(r["tag_strategy"], F.lit("")).isin(*STRATEGIES))),
    ]
    return ir.withColumn("faults", F.array_compact(F.array(*[F.when(wrong, F.lit(name)) for name, wrong in checks])))


def normalised_ir(ir: DataFrame) -> DataFrame:
    """Lists in order: words by value, rules by their name or token type."""
    by = lambda f: lambda a, b: F.when(a[f] < b[f], -1).when(a[f] > b[f], 1).otherwise(0)
    words = {c: F.array_sort(c) for c in ("mime_types", "extensions", "features", "parameters")}
    return ir.withColumns(words | {"parameter_rules": F.array_sort("parameter_rules", by("name")), "token_rules": F.array_sort("token_rules", by("token_type"))})


def filter_metadata(rows: DataFrame, column: str = "value") -> DataFrame:
    """name, entry_class, artifacts and whether both names are there, from the JSON of a filter's description file."""
    meta = F.from_json(column, "name string, entry_class string, dependencies array<struct<artifact:string>>")
    out = rows.withColumn("_m", meta).select(*[c for c in rows.columns if c != column], "_m.name", "_m.entry_class", F.transform(F.coalesce("_m.dependencies", F.array().cast("array<struct<artifact:string>>")), lambda d: d.artifact).alias("artifacts"))
    return out.withColumn("is_complete", ~blank(F.col("name")) & ~blank(F.col("entry_class")))


def dependencies(metadata: DataFrame, archives: DataFrame) -> DataFrame:
    """A row for each declared artifact (name, artifact) and whether an archive (archive) of that name was supplied."""
    supplied = F.broadcast(archives.select(F.regexp_replace("archive", r"\.jar$", "").alias("artifact"), F.lit(True).alias("supplied")).distinct())
    return metadata.select("name", F.explode("artifacts").alias("artifact")).join(supplied, "artifact", "left").fillna(False, ["supplied"])


def runtime_archive(filters: DataFrame, archives: DataFrame) -> DataFrame:
    """name and the first archive in order that is its runtime (runtime-<name>-*.jar), null without one.

    The archive's own name gives the key, so this is an equality join.
    """
    named = archives.select(F.regexp_extract("archive", r"^runtime-(.+)-[^-]*\.jar$", 1).alias("name"), "archive").groupBy("name").agg(F.min("archive").alias("archive"))
    return filters.select("name").join(named, "name", "left")


#: Words in a source that show a feature.
SIGNALS = {"code_finder": "InlineCodeFinder", "subfilter": "getSubfilter", "skeleton": "GenericSkeleton", "groups": "StartGroup"}


def java_facts(sources: DataFrame, column: str = "source_text") -> DataFrame:
    """What a Java class says of itself: class_name, super_name, mime, features, parameters (declared with their types and
    defaults, in order) and used (those of them whose getter is called)."""
    text = F.coalesce(F.col(column), F.lit(""))
    pattern = r"(boolean|int|String|double|float)\s+(\w+)\s*=\s*([^;]+);"
    every = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    kind = lambda t: F.when(t == "boolean", "boolean").when(t == "int", "integer").otherwise("string")
    declared = F.transform(F.arrays_zip(every(1).alias("t"), every(2).alias("n"), every(3).alias("v")), lambda r: F.struct(r["n"].alias("name"), kind(r["t"]).alias("value_type"), literal(r["v"]).alias("default")))
    called = F.transform(F.regexp_extract_all(text, F.lit(r"\.(?:get|is)([A-Z]\w*)\(\)"), F.lit(1)), lambda g: F.concat(F.lower(g.substr(1, 1)), g.substr(F.lit(2), F.length(g))))
    mime = F.regexp_extract(text, r"MimeTypeMapper\.(\w+)_MIME_TYPE", 1)
    return sources.withColumns(
        {
            "class_name": F.regexp_extract(text, r"class\s+(\w+)", 1), "super_name": F.nullif(F.regexp_extract(text, r"class\s+\w+\s+extends\s+(\w+)", 1), F.lit("")),
            "mime": F.nullif(F.lower(mime), F.lit("")), "features": F.array_sort(F.array_compact(F.array(*[F.when(text.contains(w), F.lit(f)) for f, w in SIGNALS.items()]))),
            "parameters": declared, "used": F.filter(F.transform(declared, lambda p: p["name"]), lambda n: F.array_contains(called, n)),
        }
    )


def literal(value: Column) -> Column:
    """The value of a Java literal: text without its quotes, a product of whole numbers worked out."""
    plain = F.trim(value)
    product = F.aggregate(F.transform(F.split(plain, r"\s*\*\s*"), lambda x: x.try_cast("bigint")), F.lit(1).cast("bigint"), lambda a, x: a * x)
    return F.when(plain.rlike(r'^".*"$'), plain.substr(F.lit(2), F.length(plain) - 2)).when(plain.rlike(r"^\d+(\s*\*\s*\d+)+$"), product.cast("string")).otherwise(plain)


def overlaid_evidence(base: DataFrame, evidence: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with what the evidence says where it says anything; empty texts and lists say nothing."""
    kinds = dict(evidence.dtypes)
    said = lambda c: F.when(F.size(c) > 0, F.col(c)) if kinds[c].startswith("array") else F.nullif(F.col(c), F.lit(""))
    new = evidence.select(key, *[said(c).alias(f"_{c}") for c in columns])
    return base.join(new, key, "left").select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def same_ids(left: DataFrame, right: DataFrame, key: str, item: str) -> DataFrame:
    """For each key whether both sides hold the same items, and what only one of them holds, in order."""
    side = lambda df, n: df.groupBy(key).agg(F.collect_set(item).alias(n))
    both = side(left, "l").join(side(right, "r"), key, "full")
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    only = lambda a, b: F.array_join(F.array_sort(F.array_except(empty(a), empty(b))), ",")
    return both.select(key, only("l", "r").alias("missing"), only("r", "l").alias("extra"), F.array_join(F.array_sort(F.array_union(empty("l"), empty("r"))), ",").alias("every")).withColumn("same", (F.col("missing") == "") & (F.col("extra") == ""))


def difference_report(differences: DataFrame, key: str, order: str) -> DataFrame:
    """One text for each stream: a line for each place that differs, in order."""
    line = F.concat(F.col(order).cast("string"), F.lit(": "), F.coalesce("left_value", F.lit("<missing>")), F.lit(" -> "), F.coalesce("right_value", F.lit("<missing>")))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return differences.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r.line), "\n").alias("report"), F.count(F.lit(1)).alias("differences"))
