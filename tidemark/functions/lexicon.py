"""Word lists of the text operators."""

from __future__ import annotations

# The words that sentiment counts.
POSITIVE = (
    "beat", "beats", "beating", "surge", "surges", "surged", "soar", "soars", "rally", "rallies", "gain", "gains", "gained", "jump", "jumps",
    "jumped", "upgrade", "upgraded", "outperform", "outperforms", "record", "records", "profit", "profits", "growth", "grow", "grows", "rise",
    "rises", "rising", "strong", "strength", "bullish", "boost", "boosts", "exceed", "exceeds", "exceeded", "top", "tops", "topped", "win", "wins",
    "expansion", "expand", "demand", "raises", "raised", "higher", "optimistic", "breakthrough", "approval", "approved", "partnership", "dividend",
    "buyback", "momentum", "rebound", "recovery", "upbeat",
)
NEGATIVE = (
    "miss", "misses", "missed", "plunge", "plunges", "plunged", "slump", "slumps", "fall", "falls", "fell", "drop", "drops", "dropped", "decline",
    "declines", "declined", "downgrade", "downgraded", "underperform", "loss", "losses", "weak", "weakness", "bearish", "cut", "cuts", "lawsuit",
    "probe", "investigation", "fraud", "recall", "warn", "warns", "warning", "layoff", "layoffs", "slowdown", "default", "bankruptcy", "lower",
    "concern", "concerns", "risk", "risks", "fears", "selloff", "crash", "halt", "halts", "ban", "fine", "fined", "delay", "delays", "scandal",
    "tumble", "tumbles", "sink", "sinks", "slash", "slashes", "woes", "struggle",
)
# Kinds of events, what they weigh, and the words that tell them; the first of equal ones holds.
# One of them has two words and never equals one.
EVENTS = (
    ("EARNINGS / GUIDANCE", 86, ("earnings", "revenue", "eps", "guidance", "outlook", "margin", "profit", "quarter")),
    ("M&A / CAPITAL ALLOCATION", 82, ("acquire", "acquisition", "merger", "takeover", "buyback", "dividend", "stake", "deal")),
    ("REGULATION / LEGAL", 78, ("regulator", "regulation", "antitrust", "lawsuit", "probe", "investigation", "ban", "fine", "approval")),
    ("PRODUCT / CUSTOMER", 68, ("launch", "product", "customer", "contract", "partnership", "order", "demand", "subscriber")),
    ("SUPPLY CHAIN", 64, ("supply", "shortage", "shipment", "factory", "plant", "capacity", "inventory", "supplier")),
    ("ANALYST / POSITIONING", 48, ("upgrade", "downgrade", "target", "analyst", "rating", "bullish", "bearish", "short interest")),
    ("MACRO / MARKET", 42, ("fed", "rates", "yield", "inflation", "tariff", "currency", "oil", "futures", "market")),
)
OTHER_EVENT = ("CORPORATE / MARKET UPDATE", 36)
# Words of high impact.
HIGH_IMPACT = (
    "bankruptcy", "default", "fraud", "recall", "halt", "ban", "acquisition", "merger", "guidance", "earnings", "approval", "investigation",
)
# Phrases that factor scores look for anywhere in a text.
GOOD_NEWS = ("growth", "expansion", "strong demand", "margin improvement", "deleveraging", "cash flow improvement", "subscriber growth", "arpu growth")
BAD_NEWS = ("risk", "decline", "margin pressure", "debt", "capex burden", "regulatory", "inflation", "weak demand", "volatility", "crude price", "forex loss")
FACTORS = {
    "debt_risk": ("debt", "borrowings", "leverage", "finance cost", "interest expense"),
    "capex_intensity": ("capital expenditure", "capex", "investment", "expansion", "project cost"),
    "margin_pressure": ("margin pressure", "lower margins", "input cost", "crude volatility", "refining margin"),
}
# Words of file names that tell a company, and its ticker; the first one holds.
TICKER_HINTS = (
    ("reliance", "RELIANCE.NS"), ("tcs", "TCS.NS"), ("infy", "INFY.NS"), ("infosys", "INFY.NS"), ("hdfc", "HDFCBANK.NS"), ("icici", "ICICIBANK.NS"), ("sbi", "SBIN.NS"),
    ("bharti", "BHARTIARTL.NS"), ("airtel", "BHARTIARTL.NS"), ("itc", "ITC.NS"), ("apple", "AAPL"), ("aapl", "AAPL"), ("microsoft", "MSFT"), ("msft", "MSFT"),
    ("nvidia", "NVDA"), ("nvda", "NVDA"), ("google", "GOOGL"), ("alphabet", "GOOGL"), ("amazon", "AMZN"), ("amzn", "AMZN"), ("meta", "META"), ("facebook", "META"),
    ("jpmorgan", "JPM"), ("jpm", "JPM"), ("blackrock", "BLK"), ("blk", "BLK"),
)
