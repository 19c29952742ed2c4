"""Connected components, and joins of a key's rows with their minimum that hot keys do not make uneven."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmengine.tables import BROADCAST_ROWS, discard, forget_shuffles, written


def salted(rows: DataFrame, by: str) -> DataFrame:
    """Add ``_salt``, which spreads a key's rows over as many pieces as there are shuffle partitions."""
    pieces = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(pieces)).cast("int"))


def with_minimum(rows: DataFrame, key: str, value: str, by: str, name: str, few: bool = False) -> DataFrame:
    """Add to each row the least ``value`` of its key's rows as ``name``; rows of a key should differ in ``by``.

    A key's minimum goes only to the pieces that its rows lie in, so it is copied at most once for each row and
    no task meets all rows of a hot key. A null key has no minimum and its rows are dropped, as by any join.
    Where the caller has counted that there are ``few`` keys, the minima are broadcast and no row moves.
    """
    if few:
        return rows.join(F.broadcast(rows.groupBy(key).agg(F.min(value).alias(name))), key)
    spread = salted(rows, by)
    least = spread.groupBy(key).agg(F.min(value).alias(name), F.collect_set("_salt").alias("_salts"))
    least = least.select(key, name, F.explode("_salts").alias("_salt"))
    return spread.join(least.hint("merge"), [key, "_salt"]).drop("_salt")


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``(id, component)`` of the vertices of ``edges(a, b)``; component is the smallest id reachable.

    Each round hooks every vertex and its neighbours to the smallest one near it, then small ones to theirs;
    all groupings are minima, so hubs are pre-aggregated, and joined with a hub's edges in pieces. Rounds are
    written out, so lost executors repeat one; up to ``BROADCAST_ROWS`` ends, counted, minima are broadcast. Each vertex's
    smallest neighbour and degree, which a round begins with, also tell that only stars at their smallest id are left, so no
    further round is run to see it. Null ends and loops link nothing; no edges give no rows.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def each(e: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
        """The pairs of columns of every row as rows (a, b), in one pass; a union would compute ``e`` once for each."""
        return e.select(F.inline(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs])))

    now = written(tidy(edges))
    ends = 2 * now.count()
    for _ in range(max_rounds):
        few = ends <= BROADCAST_ROWS
        both = each(now, ("a", "b"), ("b", "a"))
        both = both if few else salted(both, "b")
        salts = [] if few else [F.collect_set("_salt").alias("_salts")]
        around = written(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"), *salts))
        ends, open_ = around.agg(F.coalesce(F.sum("degree"), F.lit(0)), F.count_if((F.col("m") < F.col("a")) & (F.col("degree") > 1))).first()
        if not open_:
            discard(now)
            return around.select(F.col("a").alias("id"), F.least("a", "m").alias("component"))
        if few:
            near = both.join(F.broadcast(around.select("a", "m")), "a").where("b > a")
        else:
            near = both.join(around.select("a", "m", F.explode("_salts").alias("_salt")).hint("merge"), ["a", "_salt"]).where("b > a")
        large = near.select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        near = with_minimum(large if few else large.distinct(), "a", "b", "b", "m", few)
        following = written(tidy(each(near, ("b", "m"), ("a", "m"))))
        discard(now)
        discard(around)
        del both, near, large
        forget_shuffles(edges.sparkSession)
        now = following
    raise RuntimeError("components did not settle")
