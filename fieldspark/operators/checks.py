"""Gates: each returns its input, or raises ``CheckError`` that names the rule.

A gate is one job over its input that stops at the first offender or reduces to one row. Several rules of one table go
through ``require_all`` in one job, those of several tables through ``require_together``. Gates read their input by
themselves, so derived tables are best written before; ``landed_by_rules`` counts what breaks its rules as it writes.
``*_findings`` give what gates would refuse as rows, for reports over many tables or large inputs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.functions.expressions import finite
from fieldspark.sources.scratch import landed


class CheckError(ValueError):
    """A rule that input broke."""


def require_columns(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise CheckError(f"{label}: missing required columns: {', '.join(missing)}")
    return df


def require_unique(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """No two rows share ``keys``; nulls count as equal."""
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise CheckError(f"{label}: duplicate {'/'.join(keys)}")
    return df


def _some(df: DataFrame, key: str, most: int = 5) -> list[str]:
    return sorted(str(r[0]) for r in df.select(key).distinct().limit(most).collect())


def require_same_keys(left: DataFrame, right: DataFrame, key: str, label: str) -> DataFrame:
    """Both sides have the same set of non-null keys, and neither has a null; one aggregation over the keys of both."""
    sides = left.select(F.col(key).alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(F.col(key).alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    keys = sides.groupBy("k").agg(F.max("l").alias("l"), F.max("r").alias("r")).withColumn("t", F.col("k").cast("string"))
    only = {c: F.min(F.when((F.col(a) == 1) & (F.col(b) == 0), F.col("t"))).alias(c) for c, a, b in (("missing", "l", "r"), ("unknown", "r", "l"))}
    got = keys.agg(F.count_if(F.col("k").isNull()).alias("null"), *only.values())
    said = [(F.lit(f"null {key}"), F.col("null") > 0), *[(F.concat(F.lit(f"{c} {key} "), F.col(c)), F.col(c).isNotNull()) for c in only]]
    require_together(_messages(got, label, said))
    return right


def one_to_one_gate(sides: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Gate: all sides have the same keys, each once and none null. The first side sets the keys."""
    names = list(sides)
    rows = None
    for k, n in enumerate(names):
        one = sides[n].select(F.col(key).alias("k"), F.lit(k).alias("side"))
        rows = one if rows is None else rows.unionByName(one)
    counts = rows.groupBy("k").agg(*[F.count_if(F.col("side") == k).alias(f"n{k}") for k in range(len(names))])
    broken = {f"null {key}": F.count_if(F.col("k").isNull())}
    for k, n in enumerate(names):
        broken[f"{n}: duplicate {key}"] = F.count_if(F.col(f"n{k}") > 1)
        broken[f"{n}: missing {key}"] = F.count_if((F.col(f"n{k}") == 0) & (F.col("n0") > 0))
        broken[f"{n}: unknown {key}"] = F.count_if((F.col(f"n{k}") > 0) & (F.col("n0") == 0))
    got = counts.agg(*[c.alias(f"c{k}") for k, c in enumerate(broken.values())])
    return _messages(got, "", [(F.lit(m), F.col(f"c{k}") > 0) for k, m in enumerate(broken)])


def require_one_to_one(sides: Mapping[str, DataFrame], key: str) -> None:
    """All sides have the same keys, each once and none null; one job for all of them. The first side sets the keys."""
    require_together(one_to_one_gate(sides, key))


def require_reference(child: DataFrame, parent: DataFrame, key: str, label: str) -> DataFrame:
    """Every non-null key of ``child`` is in ``parent``."""
    require_together(gate(child, label, parent=parent, key=key))
    return child


def require_rules(df: DataFrame, rules: Mapping[str, Column], label: str) -> DataFrame:
    """Every rule holds wherever it is not null; all rules in one pass."""
    if not rules:
        return df
    names = list(rules)
    counts = df.agg(*[F.count_if(~rules[n]).alias(f"r{k}") for k, n in enumerate(names)]).first()
    broken = [n for k, n in enumerate(names) if counts[k]]
    if broken:
        raise CheckError(f"{label}: {'; '.join(broken)}")
    return df


def _messages(one: DataFrame, label: str, broken: Sequence[tuple[Column, Column]]) -> DataFrame:
    """label, i, message of those (message, condition) whose condition holds on a one-row table."""
    said = [F.when(c, F.struct(F.lit(i).alias("i"), m.alias("message"))) for i, (m, c) in enumerate(broken)]
    return one.select(F.lit(label).alias("label"), F.inline(F.array_compact(F.array(*said))))


def gate(df: DataFrame, label: str, rules: Mapping[str, Column] | None = None, unique: Sequence[str] = (), sums: tuple[str, str, float] | None = None, parent: DataFrame | None = None, key: str = "") -> DataFrame:
    """All of a table's gates as rows label, i, message, of which there are none if all hold: ``rules`` as in
    ``require_rules``, ``unique`` keys, ``sums`` (key, value, most) as in ``require_sums``, and every non-null ``key`` among
    those of ``parent``.

    Rows are reduced to their unique keys first (by a digest where these are more than three), broken rules summed on the
    way, then to the keys of sums or reference; the parent's keys join that aggregation as rows of their own.
    """
    rules = dict(rules or {})
    names = list(rules)
    broken = [f"_r{k}" for k in range(len(names))]
    group = [sums[0]] if sums else [key] if parent is not None else []
    digest = _digest(unique) if len(unique) > 3 else {}
    by = [*digest, *group] if digest else list(unique)
    rows = df.select(*{*(() if digest else unique), *group}, *[v.alias(n) for n, v in digest.items()], *([F.col(sums[1]).alias("_v")] if sums else []), *[(~rules[n]).cast("int").alias(b) for n, b in zip(names, broken)])
    aggs = [F.coalesce(F.sum(b), F.lit(0)).alias(b) for b in broken]
    held = [F.sum("_v").alias("_v")] if sums else []
    if unique:
        rows = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *aggs, *held)
    else:
        rows = rows.withColumn("_n", F.lit(1).cast("long"))
    most = [F.max("_n").alias("_n"), *aggs]
    extra = []
    if parent is not None and not sums:
        rows = rows.select(F.col(key).alias("_k"), "_n", *broken, F.lit(False).alias("_p"))
        known = parent.select(F.col(key).alias("_k"), F.lit(0).cast("long").alias("_n"), *[F.lit(0).cast("long").alias(b) for b in broken], F.lit(True).alias("_p"))
        rows = rows.unionByName(known).groupBy("_k").agg(*most, F.bool_or("_p").alias("_p"))
        extra = [F.count_if(F.col("_k").isNotNull() & ~F.col("_p")).alias("_lost"), F.min(F.when(~F.col("_p"), F.col("_k").cast("string"))).alias("_some")]
    elif sums:
        rows = rows.groupBy(sums[0]).agg(*most, *held)
        extra = [F.count_if(F.col("_v") > sums[2]).alias("_over"), F.min(F.when(F.col("_v") > sums[2], F.col(sums[0]).cast("string"))).alias("_some")]
    said = [(F.lit(f"duplicate {'/'.join(unique)}"), F.col("_n") > 1)] if unique else []
    said += [(F.lit(n), F.col(b) > 0) for n, b in zip(names, broken)]
    if sums:
        said.append((F.concat(F.lit(f"{sums[1]} of "), "_some", F.lit(f" exceed {sums[2]:g}")), F.col("_over") > 0))
    elif parent is not None:
        said.append((F.concat(F.lit(f"unknown {key} "), "_some"), F.col("_lost") > 0))
    if not said:
        said = [(F.lit(""), F.lit(False))]
    return _messages(rows.agg(*most, *extra), label, said)


def _digest(columns: Sequence[str]) -> dict[str, Column]:
    """128 bits of a row's columns as two numbers, which equal rows share; a hash passes over nulls, so where they are counts
    too."""
    seen = [*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns]]
    return {f"_d{k}": F.xxhash64(F.lit(k), *seen) for k in range(2)}


def require_together(*gates: DataFrame) -> None:
    """Raises what any of the gates (``gate``, ``one_to_one_gate``) says; one job for all of them, their tables side by
    side."""
    rows = gates[0]
    for g in gates[1:]:
        rows = rows.unionByName(g)
    wrong: dict[str, list[str]] = {}
    for r in sorted(rows.collect(), key=lambda r: r["i"]):
        wrong.setdefault(r["label"], []).append(r["message"])
    if wrong:
        raise CheckError("; ".join(f"{label}: {'; '.join(said)}" if label else "; ".join(said) for label, said in sorted(wrong.items())))


def require_all(df: DataFrame, label: str, rules: Mapping[str, Column] | None = None, unique: Sequence[str] = (), sums: tuple[str, str, float] | None = None, parent: DataFrame | None = None, key: str = "") -> DataFrame:
    """All of a table's gates, as ``gate`` has them, in one job."""
    require_together(gate(df, label, rules, unique, sums, parent, key))
    return df


def landed_by_rules(df: DataFrame, rules: Mapping[str, Column], label: str) -> DataFrame:
    """``df`` written and read again; every rule must hold wherever it is not null. The rules are counted by the write
    itself, so the gate is no job of its own; what breaks a rule is never returned."""
    seen = Observation()
    names = list(rules)
    counts = [F.coalesce(F.sum((~rules[n]).cast("int")), F.lit(0)).alias(f"r{k}") for k, n in enumerate(names)]
    out = landed(df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), label.replace(" ", "-"))
    broken = [n for k, n in enumerate(names) if seen.get[f"r{k}"]]
    if broken:
        raise CheckError(f"{label}: {'; '.join(broken)}")
    return out


def rule_findings(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """rule, key (as text) of each row and rule that ``require_rules`` would refuse; one pass."""
    hits = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in rules.items()]))
    return df.select(F.explode(hits).alias("rule"), F.col(key).cast("string").alias("key"))


def finite_rules(columns: Sequence[str], integral: bool = False) -> dict[str, Column]:
    """The rules of ``require_finite``."""
    rules = {}
    for c in columns:
        v = F.col(c).cast("double")
        rules[f"non-finite {c}"] = finite(v)
        if integral:
            rules[f"non-integral {c}"] = ~finite(v) | (v == F.floor(v))
    return rules


def number_rules(columns: Sequence[str], df: DataFrame | None = None) -> dict[str, Column]:
    """The rules of ``to_numbers``; columns that are numbers in ``df`` need none."""
    typed = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)} if df is not None else set()
    return {f"invalid numeric {c}": F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).isin("", "NaN", "nan") | F.expr(f"try_cast(trim(cast(`{c}` as string)) as double)").isNotNull() for c in columns if c not in typed}


def text_rules(columns: Sequence[str]) -> dict[str, Column]:
    """The rules of ``require_text``."""
    return {f"empty {c}": ~F.coalesce(F.col(c), F.lit("")).isin("", "nan") for c in columns}


def key_rules(columns: Sequence[str]) -> dict[str, Column]:
    """The rules of ``to_keys``."""
    return {f"empty {c}": F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "" for c in columns}


def duplicate_findings(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rule, key of each key that ``require_unique`` would refuse; several columns' texts are joined by a slash."""
    key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    return df.groupBy(*keys).count().where("count > 1").select(F.lit(f"duplicate {'/'.join(keys)}").alias("rule"), key.alias("key"))


def key_findings(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """rule, key of each key by which two sides differ: missing on the right, or unknown on the left. One aggregation
    over the keys of both."""
    sides = left.select(F.col(key).cast("string").alias("key"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(F.col(key).cast("string").alias("key"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    seen = sides.where("key is not null").groupBy("key").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return seen.where("l <> r").select(F.when(F.col("l") == 1, f"missing {key}").otherwise(f"unknown {key}").alias("rule"), "key")


def sum_findings(df: DataFrame, key: str, value: str, most: float) -> DataFrame:
    """rule, key of each key that ``require_sums`` would refuse."""
    over = df.groupBy(key).agg(F.sum(value).alias("s")).where(F.col("s") > most)
    return over.select(F.lit(f"sum of {value} exceeds {most:g}").alias("rule"), F.col(key).cast("string").alias("key"))


def period_findings(df: DataFrame, column: str, group: Sequence[str], first: str, last: str, rows: int) -> DataFrame:
    """rule, key of each group whose row count, least or greatest value ``require_period`` would refuse; a rule each."""
    got = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min(column).cast("string").alias("lo"), F.max(column).cast("string").alias("hi"))
    rules = {"row count": F.col("n") == rows, "first day": F.coalesce(F.col("lo") == first, F.lit(False)), "last day": F.coalesce(F.col("hi") == last, F.lit(False))}
    return rule_findings(got.withColumn("_key", F.concat_ws("/", *[F.col(g).cast("string") for g in group])), "_key", rules)


def require_finite(df: DataFrame, columns: Sequence[str], label: str, integral: bool = False) -> DataFrame:
    """Columns hold finite numbers, whole ones if ``integral``; nulls are refused."""
    return require_rules(df, finite_rules(columns, integral), label)


def to_numbers(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Text columns as double: blank is null, other text that is no number is refused, NaN is null."""
    require_rules(df, number_rules(columns, df), label)
    return as_numbers(df, columns)


def as_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns as double, without the gate: blank, NaN and what is no number are null."""

    def parsed(c: str) -> Column:
        v = F.col(c).cast("double") if isinstance(df.schema[c].dataType, T.NumericType) else F.expr(f"try_cast(trim(cast(`{c}` as string)) as double)")
        return F.when(~F.isnan(v), v)

    return df.withColumns({c: parsed(c) for c in columns})


def as_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Key columns as trimmed strings, without the gate: null is empty."""
    return df.withColumns({c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns})


def to_keys(df: DataFrame, columns: Sequence[str], label: str, may_be_empty: Sequence[str] = ()) -> DataFrame:
    """Key columns as trimmed strings; null or empty ones are refused, but for those of ``may_be_empty``, made empty."""
    require_rules(df, key_rules([c for c in columns if c not in may_be_empty]), label)
    return as_keys(df, columns)


def require_period(df: DataFrame, column: str, first: str, last: str, rows: int, label: str) -> DataFrame:
    """Row count, least and greatest value are those expected."""
    got = df.agg(F.count(F.lit(1)).alias("n"), F.min(column).cast("string").alias("lo"), F.max(column).cast("string").alias("hi")).first()
    if tuple(got) != (rows, first, last):
        raise CheckError(f"{label}: expected {rows} rows from {first} to {last}, got {got.n} from {got.lo} to {got.hi}")
    return df


def require_count(df: DataFrame, rows: int, label: str) -> DataFrame:
    if (got := df.count()) != rows:
        raise CheckError(f"{label}: expected {rows} rows, got {got}")
    return df


def require_sums(df: DataFrame, key: str, value: str, most: float, label: str) -> DataFrame:
    """No key's sum of ``value`` exceeds ``most``."""
    over = df.groupBy(key).agg(F.sum(value).alias("s")).where(F.col("s") > most)
    if bad := _some(over, key):
        raise CheckError(f"{label}: {value} of {', '.join(bad)} exceed {most:g}")
    return df


def require_text(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Columns hold text that is neither empty nor ``nan``."""
    return require_rules(df, text_rules(columns), label)
