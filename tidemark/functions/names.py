"""Tickers, their names, sectors and default benchmarks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display name of each ticker.
NAMES = (
    ("RELIANCE.NS", "Reliance Industries"),
    ("TCS.NS", "Tata Consultancy Services"),
    ("INFY.NS", "Infosys"),
    ("HDFCBANK.NS", "HDFC Bank"),
    ("ICICIBANK.NS", "ICICI Bank"),
    ("SBIN.NS", "State Bank of India"),
    ("BHARTIARTL.NS", "Bharti Airtel"),
    ("ITC.NS", "ITC Ltd"),
    ("NIFTYBEES.NS", "Nippon India ETF Nifty BeES"),
    ("AAPL", "Apple"),
    ("MSFT", "Microsoft"),
    ("NVDA", "NVIDIA"),
    ("GOOGL", "Alphabet (Google)"),
    ("AMZN", "Amazon"),
    ("META", "Meta Platforms"),
    ("JPM", "JPMorgan Chase"),
    ("BLK", "BlackRock"),
    ("SPY", "SPDR S&P 500 ETF"),
    ("QQQ", "Invesco QQQ (Nasdaq 100)"),
)
# Benchmark of Indian tickers and of all others.
INDIAN_BENCHMARK, OTHER_BENCHMARK = "NIFTYBEES.NS", "SPY"
# Exchanges of the two markets.
INDIAN_EXCHANGES = ("BSE", "BOM", "NSI", "NSE")
US_EXCHANGES = ("ASE", "BTS", "NCM", "NGM", "NMS", "NYQ", "PCX", "PNK")


def display_name(ticker: Column) -> Column:
    """The name of a ticker, or the ticker itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in NAMES for x in pair]), ticker), ticker)


def default_benchmark(ticker: Column) -> Column:
    return F.when(F.upper(ticker).endswith(".NS"), INDIAN_BENCHMARK).otherwise(OTHER_BENCHMARK)


def market(exchange: Column, symbol: Column) -> Column:
    """INDIA, US or null, by the ending of a symbol or its exchange."""
    india = symbol.endswith(".NS") | symbol.endswith(".BO") | exchange.isin(*INDIAN_EXCHANGES)
    return F.when(india, "INDIA").when(exchange.isin(*US_EXCHANGES) | (exchange == ""), "US")
