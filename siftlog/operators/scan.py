"""Running sums and earlier values along a file, with a file spread over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Line numbers of a block; a file of a billion lines is sorted in some fifteen thousand pieces.
BLOCK = 1 << 16


def along(lines: DataFrame, sums: dict[str, Column] | None = None, before: dict[str, Column] | None = None, by: tuple[str, ...] = ("path",), order: str = "line_no", block: int = BLOCK) -> DataFrame:
    """The rows with new columns: sums up to and with each row, and the last earlier values that aren't null, in ``order`` inside each ``by``.

    Windows run inside a block of ``block`` numbers only. Each block has one more row with its totals and last values; these
    are carried from block to block, and added to the rows behind. Numbers of a file are unique and whole; null sums
    count as 0; rows of a null ``by`` are a file of their own.
    """
    sums, before = sums or {}, before or {}
    rows = lines.withColumn("_block", F.floor(F.col(order) / block))
    inside = W.partitionBy(*by, "_block").orderBy(order)
    upto, earlier = inside.rowsBetween(W.unboundedPreceding, W.currentRow), inside.rowsBetween(W.unboundedPreceding, -1)
    own = rows.withColumns({f"_{n}": F.coalesce(F.sum(c).over(upto), F.lit(0)) for n, c in sums.items()} | {f"_{n}": F.last(c, ignorenulls=True).over(earlier) for n, c in before.items()})
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col(order)))
    held = rows.groupBy(*by, "_block").agg(*[F.sum(c).alias(n) for n, c in sums.items()], *[last(c).alias(n) for n, c in before.items()])
    across = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = held.select(
        *[F.col(k).alias(f"_at_{k}") for k in (*by, "_block")],
        *[F.coalesce(F.sum(n).over(across), F.lit(0)).alias(f"_far_{n}") for n in sums], *[F.last(n, ignorenulls=True).over(across).alias(f"_far_{n}") for n in before],
    )
    same = [own[k].eqNullSafe(carried[f"_at_{k}"]) for k in by]
    out = own.join(carried, [*same, own["_block"] == carried["_at__block"]])
    new = {n: F.col(f"_{n}") + F.col(f"_far_{n}") for n in sums} | {n: F.coalesce(f"_{n}", f"_far_{n}") for n in before}
    return out.select(*[c for c in lines.columns if c not in new], *[c.alias(n) for n, c in new.items()])
