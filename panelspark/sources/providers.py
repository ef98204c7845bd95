"""Payloads of quote providers, each with its own names, as rows of one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Schemas of the payloads; what a payload lacks is null.
FMP = "symbol string, price double, change double, changesPercentage double, volume double, timestamp long"
FINNHUB = "c double, d double, dp double, pc double, t long"
YAHOO = "lastPrice double, previousClose double, lastVolume double"
PROFILE = "companyName string, sector string, industry string, country string, mktCap double"
#: Currencies of markets; all others are in dollars.
CURRENCIES = {"NSE": "INR", "BSE": "INR", "NIFTY50": "INR", "SENSEX": "INR", "LSE": "GBP", "FTSE100": "GBP"}


def quote(provider: Column, payload: Column) -> Column:
    """struct(price, change, change_pct, volume) of a payload, null for one that is no JSON or names no price.

    Changes that a provider does not give follow from its previous close.
    """
    fmp, finnhub, yahoo = F.from_json(payload, FMP), F.from_json(payload, FINNHUB), F.from_json(payload, YAHOO)
    moved = lambda price, before: (price - before, F.try_divide(price - before, before) * 100)
    row = lambda price, change, pct, volume: F.struct(price.alias("price"), change.alias("change"), pct.alias("change_pct"), volume.alias("volume"))
    change, pct = moved(yahoo["lastPrice"], yahoo["previousClose"])
    none = F.lit(None).cast("double")
    chosen = F.when(provider == "fmp", row(fmp["price"], fmp["change"], fmp["changesPercentage"], fmp["volume"]))
    chosen = chosen.when(provider == "finnhub", row(finnhub["c"], F.coalesce(finnhub["d"], finnhub["c"] - finnhub["pc"]), F.coalesce(finnhub["dp"], moved(finnhub["c"], finnhub["pc"])[1]), none))
    chosen = chosen.when(provider == "yahoo", row(yahoo["lastPrice"], change, pct, yahoo["lastVolume"]))
    return F.when(chosen["price"] > 0, chosen)


def currency(market: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CURRENCIES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.upper(F.trim(market))), F.lit("USD"))


def profiles(names: DataFrame, ticker: str, payloads: DataFrame, payload: str) -> DataFrame:
    """(ticker, company, sector, industry, country, market_cap) of every name; what its payload does not tell is a default."""
    p = F.from_json(payload, PROFILE)
    known = payloads.select(ticker, p.alias("p"))
    told = lambda c: F.coalesce(F.nullif(F.trim(F.col(f"p.{c}")), F.lit("")), F.lit("Unknown"))
    joined = names.select(ticker).join(known, ticker, "left")
    return joined.select(ticker, F.coalesce(F.nullif(F.trim("p.companyName"), F.lit("")), F.col(ticker).cast("string")).alias("company"), told("sector").alias("sector"), told("industry").alias("industry"), told("country").alias("country"), F.coalesce("p.mktCap", F.lit(0.0)).alias("market_cap"))
