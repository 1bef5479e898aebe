"""Which columns can be predicted, and which may serve as features."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismtab.functions.coerce import col
from prismtab.functions.names import ascii_snake, closeness
from prismtab.functions.rounding import half_up_value
from prismtab.operators.profile import ColumnStats, column_stats, local_frame

# Names that suggest a number or a class to predict.
REGRESSION_HINTS = ("sales", "revenue", "amount", "profit", "price", "total", "value", "income", "cost")
CLASSIFICATION_HINTS = (
    "churn", "status", "class", "category", "label", "target", "outcome", "approved", "converted")
MOST_VALUES = 50
# The columns that stand for a metric, the first one present is the target, and its task.
METRIC_TARGETS = {
    "profit": (("profit", "total_profit", "net_profit"), "regression"),
    "quantity": (("quantity", "total_quantity"), "regression"),
    "category": (("category", "subcategory"), "classification"),
    "revenue": (("total_sales", "revenue", "sales", "net_sales"), "regression"),
}


def target_for_metric(columns: list[str], metric: str | None, question: str = "") -> tuple[str | None, str]:
    """(column, task) to predict for a metric. A question about categories asks for the category, unless the metric
    is profit or quantity; every other metric is revenue. None without such a column."""
    asked = metric if metric in ("profit", "quantity") else "category" if "category" in question.lower() else "revenue"
    names, task = METRIC_TARGETS[asked]
    present = {name.lower(): name for name in reversed(columns)}
    return next((present[name] for name in names if name in present), None), task


def metric_targets(df: DataFrame, questions: dict[str, str | None]) -> DataFrame:
    """(question, target_column, task_type, filled_rows) for questions, each with the metric it is about."""
    found = [(question, *target_for_metric(df.columns, metric, question)) for question, metric in questions.items()]
    used = sorted({target for _, target, _ in found if target})
    counts = df.agg(*(F.count(col(c)).alias(f"n{i}") for i, c in enumerate(used))).first() if used else ()
    filled = dict(zip(used, counts))
    return local_frame(df.sparkSession, [(q, t, task, filled.get(t, 0)) for q, t, task in found],
                       "question string, target_column string, task_type string, filled_rows bigint")


def name_fit(name: str, hints: tuple[str, ...]) -> float:
    plain = ascii_snake(name)
    return max(closeness(plain, hint, 0.9, 0.82, 0.7) for hint in hints)


def task_for(stats: ColumnStats) -> str | None:
    """Regression, classification, or neither; from ten values on."""
    if stats.filled < 10:
        return None
    if stats.kind == "bool":
        return "classification"
    number = stats.kind == "number"
    few = max(20, int(stats.filled * (0.2 if number else 0.4)))
    if 2 <= stats.distinct <= few:
        return "classification"
    if number:
        return "regression"
    return "classification" if stats.distinct >= 2 and stats.distinct_share <= 0.3 else None


def confidence(stats: ColumnStats, task: str) -> float:
    """How safe a target is. The points of each sign."""
    number = stats.kind in ("number", "bool")
    if task == "regression":
        points = [
            (0.55, True), (min(0.2, name_fit(stats.name, REGRESSION_HINTS) * 0.2), True),
            (0.12, number), (0.08, stats.distinct_share > 0.7), (-0.25, stats.distinct < 5),
        ]
    else:
        points = [
            (0.52, True), (min(0.2, name_fit(stats.name, CLASSIFICATION_HINTS) * 0.2), True),
            (0.12, stats.distinct <= max(10, int(stats.filled * 0.25))),
            (0.08, stats.distinct_share <= 0.3), (-0.05, stats.distinct <= 2),
            (-0.15, number and stats.distinct > 20),
        ]
    points += [(-0.45, stats.identifier_like), (min(0.12, stats.filled / max(1, stats.rows) * 0.12), True)]
    total = sum(p for p, holds in points if holds)
    return half_up_value(min(0.99, max(0.0, total)), 3)


def suggestions(stats: list[ColumnStats]) -> list[tuple[str, str, float, int, int, bool]]:
    """(column, task, confidence, filled rows, distinct values, safe), best first."""
    found = []
    for s in stats:
        task = None if s.identifier_like else task_for(s)
        if task:
            score = confidence(s, task)
            found.append((s.name, task, score, s.filled, s.distinct, score >= 0.5))
    return sorted(found, key=lambda row: (-row[2], -row[3]))


def suggest_targets(df: DataFrame, stats: list[ColumnStats] | None = None, limit: int = 6) -> DataFrame:
    rows = suggestions(column_stats(df) if stats is None else stats)[:limit]
    return local_frame(df.sparkSession, rows, (
        "column_name string, task_type string, confidence double, non_null_rows bigint, "
        "unique_values bigint, safe boolean"))


def choose_target(stats: list[ColumnStats], target: str | None = None, at_least: float = 0.0):
    """The named target if it is a safe suggestion, else the best one; None when there is none."""
    ranked = suggestions(stats)
    if target:
        return next((row for row in ranked if row[0].lower() == target.lower()), None)
    return ranked[0] if ranked and ranked[0][2] >= at_least else None


def chosen_target(df: DataFrame, stats: list[ColumnStats] | None = None, at_least: float = 0.0) -> DataFrame:
    """(column_name, task_type, confidence) of the best target, one row or none."""
    best = choose_target(column_stats(df) if stats is None else stats, at_least=at_least)
    return local_frame(df.sparkSession, [best[:3]] if best else [], "column_name string, task_type string, confidence double")


def identifier_like(df: DataFrame, stats: list[ColumnStats] | None = None) -> DataFrame:
    rows = [(s.name, half_up_value(s.distinct_share, 4), s.identifier_like)
            for s in (column_stats(df) if stats is None else stats)]
    return local_frame(df.sparkSession, rows,
                       "column_name string, distinct_share double, is_identifier_like boolean")


def _flat(name: str) -> str:
    return name.lower().replace("_", "")


def exclusion(stats: ColumnStats, target: str, ids_by_name: bool = False, most_values: int = MOST_VALUES) -> str | None:
    """Why a column cannot be a feature for the target; None when it can. A text column may have ``most_values`` values."""
    wanted, name = _flat(target), _flat(stats.name)
    identifier = stats.name == "id" or stats.name.endswith("_id") if ids_by_name else stats.identifier_like
    reasons = [
        ("target", stats.name == target),
        ("constant", stats.distinct <= 1),
        ("identifier", identifier),
        ("leakage", len(wanted) > 3 and (wanted in name or name in wanted)),
        ("high_cardinality", stats.kind not in ("number", "bool") and stats.distinct > most_values),
    ]
    return next((reason for reason, holds in reasons if holds), None)


def safe_features(df: DataFrame, target: str, stats: list[ColumnStats] | None = None, most_values: int = MOST_VALUES) -> DataFrame:
    """Every column with whether it may be a feature, and if not, why."""
    rows = []
    for s in column_stats(df) if stats is None else stats:
        reason = exclusion(s, target, most_values=most_values)
        rows.append((s.name, reason is None, reason or ""))
    return local_frame(df.sparkSession, rows, "column_name string, is_feature boolean, reason string")
