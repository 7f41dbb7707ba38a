"""Data-quality rules and contracts: one pass for all metrics, one mask for the split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laketide.functions.scalars import any_of, percent
from laketide.operators.aggregates import unpivot_row
from laketide.operators.joins import join_null_safe
from laketide.operators.windows import latest_per_key


@dataclass(frozen=True)
class Rule:
    """A named check. ``fails`` is true for a bad row; NULL means the check cannot tell.
    ``flagged`` marks a check on a flag that a join added to the frame."""

    name: str
    fails: Column
    severity: str = "error"
    action: str = "quarantine"
    flagged: bool = False


class BatchRejected(RuntimeError):
    """Raised by a gate before anything is published."""


class ExpectationFailed(RuntimeError):
    """A row breaks an expectation that must hold for all."""


# ---- rules from declarations ---------------------------------------------------------


def contract_rules(contract: Mapping) -> list[Rule]:
    """Compile ``{"columns": {name: {...}}}``. Per column: ``nullable`` (bool), ``pattern``,
    ``allowed``, ``min``, ``max``. All but the null check look at non-NULL values only."""
    rules: list[Rule] = []
    for name, spec in contract["columns"].items():
        c = F.col(name)
        severity = spec.get("severity", "error")

        def add(kind: str, fails: Column) -> None:
            rules.append(Rule(f"{name}_{kind}", fails, severity))

        if not spec.get("nullable", True):
            add("null", c.isNull())
        if "pattern" in spec:
            add("pattern", c.isNotNull() & ~c.rlike(spec["pattern"]))
        if "allowed" in spec:
            add("allowed", c.isNotNull() & ~c.isin(*spec["allowed"]))
        if "min" in spec:
            add("min", c.isNotNull() & (c < F.lit(spec["min"])))
        if "max" in spec:
            add("max", c.isNotNull() & (c > F.lit(spec["max"])))
    return rules


def quote_columns(expression: str, columns: Sequence[str]) -> str:
    """Backtick the column names that Spark SQL cannot read bare, such as non-ASCII ones."""
    import re

    odd = sorted((c for c in columns if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", c)), key=len, reverse=True)
    if not odd:
        return expression
    names = "|".join(re.escape(c) for c in odd)
    # quoted text and names that already stand in backticks are left alone
    pieces = re.split(r"('(?:[^'\\]|\\.|'')*'|`[^`]*`)", expression)
    return "".join(p if i % 2 else re.sub(rf"(?<!\w)({names})(?!\w)", r"`\1`", p) for i, p in enumerate(pieces))


def sql_rules(declared: Sequence[Mapping], columns: Sequence[str]) -> list[Rule]:
    """Rules written as SQL conditions that good rows meet."""
    return [
        Rule(
            d["id"],
            ~F.expr(f"({quote_columns(d['expression'], columns)})"),
            d.get("severity", "error"),
            d.get("action_on_fail", "quarantine"),
        )
        for d in declared
    ]


def with_reference_flag(df: DataFrame, reference: DataFrame, column: str, key: str, name: str) -> DataFrame:
    """Add ``name``: true when the value has no row in the reference table."""
    known = reference.select(F.col(key).alias(column)).where(F.col(column).isNotNull()).distinct()
    found = join_null_safe(df, known.withColumn("__known", F.lit(True)), [column])
    return found.withColumn(name, F.col("__known").isNull()).drop("__known")


def with_duplicate_flag(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: true when the key has several rows. Counts are joined back, so a key
    with very many copies is not gathered in one task."""
    copies = df.groupBy(*keys).agg((F.count("*") > 1).alias(name))
    return join_null_safe(df, copies, keys)


def rule_table_rules(
    df: DataFrame, rule_rows: Sequence[Mapping], references: Mapping[str, tuple[DataFrame, str]]
) -> tuple[DataFrame, list[Rule]]:
    """Rules kept as table rows. ``X UNIQUE`` and ``X EXISTS IN table`` become flags on the
    returned frame, everything else is a SQL condition."""
    rules: list[Rule] = []
    for row in rule_rows:
        text, rule_id = row["rule_expression"].strip(), row["rule_id"]
        if row["rule_type"] == "uniqueness":
            flag = f"__dup_{rule_id}"
            df = with_duplicate_flag(df, [text.split()[0]], flag)
            fails = F.col(flag)
        elif row["rule_type"] == "referential_integrity":
            column, table = text.split()[0], text.split()[-1]
            reference, key = references[table]
            flag = f"__orphan_{rule_id}"
            df = with_reference_flag(df, reference, column, key, flag)
            fails = F.col(flag)
        else:
            fails = ~F.expr(f"({quote_columns(text, df.columns)})")
        flagged = row["rule_type"] in ("uniqueness", "referential_integrity")
        rules.append(Rule(rule_id, fails, row["severity"], row["action_on_fail"], flagged))
    return df, rules


# ---- evaluation ----------------------------------------------------------------------


def rule_metrics(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: failed, unknown, total, failure_pct, pass_pct. A single aggregate."""
    aggs = [F.count("*").alias("total")]
    for i, r in enumerate(rules):
        aggs += [F.count_if(r.fails).alias(f"f{i}"), F.count_if(r.fails.isNull()).alias(f"u{i}")]
    rows = unpivot_row(
        df.agg(*aggs),
        [
            (
                {"rule": r.name, "severity": r.severity, "action": r.action},
                {"failed": f"f{i}", "unknown": f"u{i}", "total": "total"},
            )
            for i, r in enumerate(rules)
        ],
    )
    return rows.withColumns(
        {
            "failure_pct": percent(F.col("failed"), F.col("total")),
            "pass_pct": percent(F.col("total") - F.col("failed"), F.col("total")),
        }
    )


def annotate(df: DataFrame, rules: Sequence[Rule], column: str = "failed_rules") -> DataFrame:
    """Add the names of all failing rules as ``[rule_a][rule_b]``, empty when none fails."""
    marks = [F.when(r.fails, F.lit(f"[{r.name}]")) for r in rules]
    return df.withColumn(column, F.concat_ws("", *marks))


def bad_mask(rules: Sequence[Rule], null_policy: str = "fail") -> Column:
    """OR of the error rules. ``drop`` keeps the three-valued result, so an undecidable row
    goes to neither side; ``fail`` counts it as bad, ``pass`` as good."""
    mask = any_of([r.fails for r in rules if r.severity == "error"])
    if null_policy == "drop":
        return mask
    return F.coalesce(mask, F.lit({"fail": True, "pass": False}[null_policy]))


def split(df: DataFrame, rules: Sequence[Rule], null_policy: str = "fail") -> tuple[DataFrame, DataFrame]:
    """Valid and invalid rows by the error rules; warnings never remove a row."""
    mask = bad_mask(rules, null_policy)
    return df.where(~mask), df.where(mask)


def gate(metrics: Mapping[str, float], limit_pct: float) -> None:
    """Stop the batch before it is published when too many rows are invalid."""
    if metrics["invalid_pct"] > limit_pct:
        raise BatchRejected(f"{metrics['invalid_pct']:.4f}% invalid rows, limit {limit_pct}%")


def batch_metrics(df: DataFrame, rules: Sequence[Rule], null_policy: str = "fail") -> DataFrame:
    """total, valid, invalid and invalid_pct of a batch in one row."""
    mask = bad_mask(rules, null_policy)
    counts = df.agg(F.count("*").alias("total"), F.count_if(~mask).alias("valid"), F.count_if(mask).alias("invalid"))
    return counts.withColumn("invalid_pct", F.coalesce(percent(F.col("invalid"), F.col("total")), F.lit(0.0)))


def expectations(df: DataFrame, warn: Sequence[Rule] = (), drop: Sequence[Rule] = (), fail: Sequence[Rule] = ()) -> DataFrame:
    """Keep-with-warning, drop and fail expectations on one frame. A check that cannot tell
    counts as broken. ``fail`` rules are counted over all rows first, in one aggregate: as a
    filter they could be passed over for rows that a ``drop`` rule removes."""
    out = df
    if fail:
        counts = df.agg(*[F.count_if(F.coalesce(r.fails, F.lit(True))).alias(f"r{i}") for i, r in enumerate(fail)]).first()
        broken = [f"expectation {r.name} failed for {counts[i]} rows" for i, r in enumerate(fail) if counts[i]]
        if broken:
            raise ExpectationFailed("; ".join(broken))
    for r in drop:
        out = out.where(~F.coalesce(r.fails, F.lit(True)))
    return annotate(out, list(warn), "warnings") if warn else out


def apply_rule_actions(
    raw: DataFrame, flagged: DataFrame, rules: Sequence[Rule], key: Sequence[str], newest_by: Sequence[str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Act on rules by their action: ``quarantine`` splits, ``deduplicate`` keeps the newest
    row per key. Returns clean rows, quarantined rows and the per-rule outcome, whose
    ``fired`` column tells the caller which ``reject_batch`` and ``alert`` rules tripped.

    ``flagged`` is ``raw`` with the joined flags; rows are split on it only when a quarantine
    rule needs a flag, so that the usual split is a plain filter.
    """
    quarantine = [Rule(r.name, r.fails, flagged=r.flagged) for r in rules if r.action == "quarantine"]
    base = flagged if any(r.flagged for r in quarantine) else raw
    good, bad = (part.select(*raw.columns) for part in split(base, quarantine, "fail"))
    if any(r.action == "deduplicate" for r in rules):
        good = latest_per_key(good, key, newest_by)
    outcome = rule_metrics(flagged, rules).withColumn("fired", (F.col("failed") + F.col("unknown")) > 0)
    return good, bad, outcome


# ---- schema checks and reports --------------------------------------------------------


def schema_drift(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """One row per missing or extra column, with the rows that fill an extra column."""
    extra = [c for c in df.columns if c not in expected]
    entries = [({"column": c, "drift": "missing"}, {"filled_rows": "__none"}) for c in expected if c not in df.columns]
    entries += [({"column": c, "drift": "extra"}, {"filled_rows": f"__f_{c}"}) for c in extra]
    if not entries:
        return df.sparkSession.createDataFrame([], "column string, drift string, filled_rows bigint")
    filled = df.agg(F.count_if(F.lit(False)).alias("__none"), *[F.count(c).alias(f"__f_{c}") for c in extra])
    return unpivot_row(filled, entries)


def null_percentages(df: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """NULL share per column against its limit, from one pass."""
    aggs = [F.count("*").alias("total")] + [F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in limits]
    rows = unpivot_row(
        df.agg(*aggs),
        [({"column": c, "max_pct": float(limit)}, {"nulls": f"n_{c}", "total": "total"}) for c, limit in limits.items()],
    )
    pct = F.coalesce(percent(F.col("nulls"), F.col("total")), F.lit(0.0))
    return rows.withColumn("null_pct", pct).withColumn("breached", F.col("null_pct") > F.col("max_pct"))


def quarantined(df: DataFrame, run_id: str, reason: Column, at: Column) -> DataFrame:
    """The form in which bad rows are appended to a quarantine table."""
    return df.withColumns({"_reason": reason, "_run_id": F.lit(run_id), "_quarantined_at": at})


def layer_reconciliation(df: DataFrame, layers: Mapping[str, Column], base: str) -> DataFrame:
    """Rows per layer and the share lost against ``base``, from one pass. A layer is the
    condition that sends a row of the raw table there."""
    counts = df.agg(*[F.count_if(c).alias(f"n_{n}") for n, c in layers.items()], F.count_if(layers[base]).alias("base_rows"))
    rows = unpivot_row(counts, [({"layer": n}, {"rows": f"n_{n}", "base_rows": "base_rows"}) for n in layers])
    lost = percent(F.col("base_rows") - F.col("rows"), F.col("base_rows"))
    return rows.withColumn("drop_pct", lost).drop("base_rows")
