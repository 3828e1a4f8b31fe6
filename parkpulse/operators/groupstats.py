"""Group comparisons: one-way analysis of variance, its form for several responses, pairwise ranges.

The data is read once, into a count, means and centred products per group; everything after that
works on one row per group. Sums of whole numbers and decimals are exact, so their means are; products
are centred from the start, and groups are compared around the grand mean. So a shift of all values,
or a change of their unit, changes no test.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, IntegralType

from parkpulse.functions.distributions import f_p_value, range_critical_value, range_p_value

# Groups that one task compares with all others.
PAIR_BLOCK = 256
# A response is redundant if less than this share of its deviation is its own.
SINGULAR = 1e-7


def _mean(df: DataFrame, response: str) -> Column:
    kind = df.schema[response].dataType
    if isinstance(kind, (IntegralType, DecimalType)):
        scale = kind.scale if isinstance(kind, DecimalType) else 0
        total = F.sum(F.col(response).cast(f"decimal(38,{scale})"))
        return total.cast("double") / F.count(F.lit(1))
    return F.avg(F.col(response).cast("double"))


def _moments(df: DataFrame, group: str, responses: tuple[str, ...]) -> DataFrame:
    """Per group: name, n, means m_i and products w_i_j = sum((y_i - m_i) * (y_j - m_j))."""
    kept = df.na.drop("any", subset=[group, *responses])
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, r in enumerate(responses):
        aggs.append(_mean(df, r).alias(f"m_{i}"))
        for j, other in enumerate(responses[i:], i):
            product = F.covar_pop(F.col(r).cast("double"), F.col(other).cast("double"))
            aggs.append((product * F.count(F.lit(1))).alias(f"w_{i}_{j}"))
    rows = kept.groupBy(F.col(group).alias("name")).agg(*aggs)
    # A generator keeps all columns, so that a scalar read from these rows shares their shuffle.
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def _scatter(moments: DataFrame, responses: int) -> DataFrame:
    """One row: groups k, rows n, within-group w_i_j and between-group h_i_j scatter."""
    grand = moments.agg(
        F.struct(
            *[(F.sum(F.col("n") * F.col(f"m_{i}")) / F.sum("n")).alias(f"g_{i}") for i in range(responses)]
        ).alias("grand")
    ).scalar()
    off = [F.col(f"m_{i}") - F.col("grand")[f"g_{i}"] for i in range(responses)]
    aggs = [F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")]
    for i in range(responses):
        for j in range(i, responses):
            aggs.append(F.sum(f"w_{i}_{j}").alias(f"w_{i}_{j}"))
            aggs.append(F.sum(F.col("n") * off[i] * off[j]).alias(f"h_{i}_{j}"))
    return moments.withColumn("grand", grand).agg(*aggs)


def anova(df: DataFrame, group: str, responses: tuple[str, ...]) -> DataFrame:
    """One-way analysis of variance, one row per response."""
    row = _scatter(_moments(df, group, responses), len(responses))
    per_response = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(r).alias("response"),
                    F.col(f"h_{i}_{i}").alias("between"),
                    F.col(f"w_{i}_{i}").alias("within"),
                )
                for i, r in enumerate(responses)
            ]
        )
    )
    split = row.select("k", "n", per_response.alias("r")).select("k", "n", "r.*")
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    f = (F.col("between") / df1) / (F.col("within") / df2)
    return split.select(
        "response", df1.alias("df_between"), df2.alias("df_within"),
        F.col("between").alias("ss_between"), F.col("within").alias("ss_within"),
        f.alias("f_value"),
    ).withColumn(
        "p_value",
        f_p_value("f_value", F.col("df_between").cast("double"), F.col("df_within").cast("double")),
    )


@F.pandas_udf(ArrayType(DoubleType()))
def _roots(between: pd.Series, total: pd.Series) -> pd.Series:
    """Eigenvalues of total^-1 * between, largest first, for one pair of matrices a row.

    Responses are brought to unit total scatter, then total = L * L' turns the problem into a
    symmetric one. Null where the total scatter has no inverse: a constant or redundant response.
    """
    out = []
    for h, t in zip(between, total):
        p = isqrt(len(t))
        h, t = np.reshape(h, (p, p)), np.reshape(t, (p, p))
        unit = np.sqrt(np.diag(t))
        if not np.all(unit > 0):
            out.append(None)
            continue
        scale = np.outer(unit, unit)
        try:
            lower = np.linalg.cholesky(t / scale)
        except np.linalg.LinAlgError:
            out.append(None)
            continue
        if np.min(np.diag(lower)) < SINGULAR:
            out.append(None)
            continue
        half = np.linalg.solve(lower, h / scale)
        out.append(np.clip(np.linalg.eigvalsh(np.linalg.solve(lower, half.T))[::-1], 0.0, 1.0))
    return pd.Series(out)


def _matrix(name: str, responses: int) -> Column:
    """The symmetric matrix whose upper half stands in columns, row by row."""
    cells = [(min(i, j), max(i, j)) for i in range(responses) for j in range(responses)]
    return F.array(*[F.col(f"{name}_{i}_{j}") for i, j in cells])


def manova_tests(df: DataFrame, group: str, responses: tuple[str, ...]) -> DataFrame:
    """The four usual tests of a one-way analysis of any number of responses, one row each.

    Columns test, df_between, df_within, statistic, approx_f, num_df, den_df, p_value. All follow from
    the roots r of total^-1 * between: Pillai's trace sum(r), Wilks' lambda prod(1 - r), the
    Hotelling-Lawley trace sum(r / (1 - r)) and Roy's root max(r / (1 - r)); Roy's F is an upper bound.
    Statistics are null where responses are constant or redundant, and the last two where a
    response does not vary within groups. Rows with a null group or response are left out.
    """
    p = len(responses)
    row = _scatter(_moments(df, group, responses), p)
    row = row.withColumns(
        {f"t_{i}_{j}": F.col(f"w_{i}_{j}") + F.col(f"h_{i}_{j}") for i in range(p) for j in range(i, p)}
    )
    q, within = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    row = row.select(
        (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"),
        q.alias("q"), within.alias("e"), F.least(F.lit(float(p)), q).alias("s"),
        ((F.abs(q - p) - 1) / 2).alias("m"), ((within - p - 1) / 2).alias("l"),
        _roots(_matrix("h", p), _matrix("t", p)).alias("roots"),
    )
    q, e, s, m, n = (F.col(c) for c in ("q", "e", "s", "m", "l"))
    # A group more or less than the responses leaves roots that are zero but for rounding; they add nothing.
    one, zero = F.lit(1.0), F.lit(0.0)
    odds = F.transform("roots", lambda r: r / F.nullif(1 - r, zero))
    pillai = F.aggregate("roots", zero, lambda a, r: a + r)
    wilks = F.aggregate("roots", one, lambda a, r: a * (1 - r))
    hotelling = F.aggregate(odds, zero, lambda a, r: a + r)
    roy = F.get(odds, F.lit(0))

    def test(name: str, value: Column, f: Column, num: Column, den: Column) -> Column:
        return F.struct(
            F.lit(name).alias("test"), value.alias("statistic"), f.alias("approx_f"), num.alias("num_df"), den.alias("den_df")
        )

    low, high = m * 2 + s + 1, n * 2 + s + 1
    squares = q * q + p * p - 5
    t = F.when(squares > 0, F.sqrt((q * q * p * p - 4) / squares)).otherwise(one)
    den = (e - (p - q + 1) / 2) * t - (q * p - 2) / 2
    up = (s * n + 1) * 2
    most = F.greatest(F.lit(float(p)), q)
    tests = F.array(
        test("pillai", pillai, high / low * pillai / F.nullif(s - pillai, zero), s * low, s * high),
        test("wilks", wilks, (F.pow(F.nullif(wilks, zero), -1 / t) - 1) * den / (q * p), q * p, den),
        test("hotelling_lawley", hotelling, up * hotelling / (s * s * low), s * low, up),
        test("roy", roy, (e - most + q) * roy / most, most, e - most + q),
    )
    rows = row.where((q > 0) & (e > 0)).select("df_between", "df_within", F.inline(tests))
    return rows.select("test", "df_between", "df_within", "statistic", "approx_f", "num_df", "den_df").withColumn(
        "p_value", F.when(F.col("approx_f").isNotNull() & (F.col("den_df") > 0), f_p_value("approx_f", "num_df", "den_df"))
    )


def manova(df: DataFrame, group: str, responses: tuple[str, ...]) -> DataFrame:
    """Analysis of variance of several responses by Pillai's trace and its F approximation."""
    return (
        manova_tests(df, group, responses)
        .where(F.col("test") == "pillai")
        .select("df_between", "df_within", F.col("statistic").alias("pillai"), "approx_f", "num_df", "den_df", "p_value")
    )


def tukey(df: DataFrame, group: str, response: str, level: float = 0.95) -> DataFrame:
    """Honest significant differences for each pair of groups.

    Every pair is a row of the result. Groups are dealt into blocks of about PAIR_BLOCK; each block
    meets all groups in a join on its number, so pairs are made and tested by as many tasks.
    """
    moments = _moments(df, group, (response,))
    k, n = F.count(F.lit(1)), F.sum("n")
    freedom = (n - k).cast("double")
    totals = moments.agg(
        F.struct(
            k.alias("k"), freedom.alias("df_within"), (F.sum("w_0_0") / freedom).alias("mse"),
            F.ceil(k / PAIR_BLOCK).cast("int").alias("blocks"),
        ).alias("all")
    ).scalar()
    rows = moments.withColumn("all", totals)
    every = F.explode(F.sequence(F.lit(0), F.col("all.blocks") - 1)).alias("block")
    own = F.pmod(F.xxhash64("name"), F.col("all.blocks")).cast("int").alias("block")
    member = F.struct("name", "n", F.col("m_0").alias("mean"))
    pairs = (
        rows.select(every, member.alias("a"), "all")
        .join(rows.select(own, member.alias("b")), "block")
        .where(F.col("a.name") < F.col("b.name"))
        .select("a", "b", "all.k", "all.df_within", "all.mse")
    )
    diff = F.col("b.mean") - F.col("a.mean")
    error = F.sqrt(F.col("mse") / 2 * (1 / F.col("a.n") + 1 / F.col("b.n")))
    stats = pairs.select(
        F.concat("b.name", F.lit("-"), "a.name").alias("comparison"),
        diff.alias("diff"), error.alias("std_error"), "k", "df_within",
        (F.abs(diff) / error).alias("q_value"),
    ).withColumn("p_adjusted", range_p_value("q_value", "k", "df_within"))
    half = range_critical_value(F.lit(level), "k", "df_within") * F.col("std_error")
    return stats.withColumn("half", half).select(
        "comparison", "diff",
        (F.col("diff") - F.col("half")).alias("lower"),
        (F.col("diff") + F.col("half")).alias("upper"),
        "std_error", "q_value", "p_adjusted",
    )
