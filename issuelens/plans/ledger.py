"""The frozen rule and its write-once ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.merge import ledger_merge
from ..operators.ordering import trailing_bars

CALL_COLS = ["opened", "recorded_at", "rule_says", "qib", "retail", "qib_bar", "retail_bar"]
OUTCOME_COLS = ["ret_6m_from_listing", "ret_12m_from_listing"]


def frozen_rule(issues: DataFrame, day: str = "opened", row_id: str = "cg_ipo_id", qib: str = "qib",
                retail: str = "retail", n: int = 60, min_n: int = 20) -> DataFrame:
    """Calls of the frozen rule: QIB above its trailing median, retail at or below its own.

    The bars come from the last ``n`` issues opened on strictly earlier days; a row
    without both values or both bars makes no call.
    """
    bars = trailing_bars(issues, day, row_id, [qib, retail], n, min_n)
    joined = issues.join(bars, day).filter(
        F.col(qib).isNotNull() & F.col(retail).isNotNull()
        & F.col(f"{qib}_bar").isNotNull() & F.col(f"{retail}_bar").isNotNull())
    says = (F.col(qib) > F.col(f"{qib}_bar")) & (F.col(retail) <= F.col(f"{retail}_bar"))
    return joined.withColumn("rule_says", F.when(says, "BUY-CANDIDATE").otherwise("no"))


def update_ledger(ledger: DataFrame, calls: DataFrame, key: str = "cg_ipo_id") -> DataFrame:
    return ledger_merge(ledger, calls, key, CALL_COLS, OUTCOME_COLS)
