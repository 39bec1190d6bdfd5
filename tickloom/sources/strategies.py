"""Strategy-result scans: delimiter by count, header aliases, tolerant numbers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.functions.columns import number_of, text_of

# Header aliases of exported result tables.
ALIASES = {
    "netprofit": ("netprofit", "net profit", "net_profit"),
    "profitfactor": ("profitfactor", "profit factor", "pf"),
    "winlossratio": ("winlossratio", "win/loss ratio", "win loss ratio", "wlr"),
    "percentprofitable": ("percentprofitable", "%win", "win%", "percent profitable"),
    "numberoftrades": ("numberoftrades", "#trades", "trades", "number of trades"),
    "maxdrawdownpct": ("maxdrawdownpct", "max drawdown %", "drawdown%", "drawdown pct"),
    "sharperatio": ("sharperatio", "sharpe ratio", "sharpe"),
    "returnddratio": ("ret/dd ratio", "ret/ddratio", "retddratio", "ret/dd"),
    "timeinmarket": ("timeinmarket", "time in market", "avgtimeinmarket"),
    "strategyname": ("strategyname", "strategy name", "name", "strategy"),
}


def plain_header(name: str) -> str:
    return re.sub(r"[\s._%#/]", "", name.lower())


# first metric wins where two share an alias
_CANONICAL: dict[str, str] = {}
for _metric, _names in ALIASES.items():
    for _name in (_metric, *_names):
        _CANONICAL.setdefault(plain_header(_name), _metric)


def canonical(header: str) -> str | None:
    """Metric name of a header, or None if it is not known."""
    return _CANONICAL.get(plain_header(header))


def canonical_rows(raw: DataFrame) -> tuple[DataFrame, list[str]]:
    """Metric columns as DOUBLE (names as text), plus the headers that map to nothing.

    Where two headers mean the same metric the later one wins.  Only metadata is
    looked at on the driver.
    """
    source: dict[str, str] = {}
    for header in raw.columns:
        if canonical(header):
            source[canonical(header)] = header
    cols = []
    for metric, header in source.items():
        h = F.col(f"`{header}`")
        if metric == "strategyname":
            cols.append(F.coalesce(text_of(h), number_of(h).cast("string")).alias(metric))
        else:
            cols.append(number_of(h).alias(metric))
    unmapped = sorted(h for h in raw.columns if canonical(h) is None)
    return raw.select(*cols), unmapped


def read_strategies(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Scan an exported table; the header line tells whether ``;`` or ``,`` separates."""
    first = spark.read.text(path).first()
    header = first.value if first else ""
    sep = ";" if header.count(";") > header.count(",") else ","
    return canonical_rows(spark.read.option("header", True).option("sep", sep).csv(path))
