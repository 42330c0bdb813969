"""Rule vocabularies as data. Types are in tie order; patterns run over lower-cased text."""

from __future__ import annotations

# Keywords and patterns by type. Patterns that cannot match lower-cased ASCII text are left out.
TABLE_TYPES: dict[str, tuple[list[str], list[str]]] = {
    "financial_income": (
        ["revenue", "income", "expense", "profit", "loss", "earnings", "ebitda", "margin", "sales", "cost", "operating", "net income", "gross profit"],
        [r"\$[0-9,]+", "million", "billion", "thousand", "mn", "bn"],
    ),
    "financial_balance": (
        ["assets", "liabilities", "equity", "debt", "capital", "cash", "receivables", "payables", "inventory", "goodwill"],
        [r"\$[0-9,]+", "balance sheet", "statement of financial position"],
    ),
    "financial_cashflow": (["cash flow", "operating", "investing", "financing", "free cash flow", "capex", "working capital", "dividends"], ["cash", "flow", "fcf"]),
    "financial_ratios": (
        ["ratio", "margin", "roe", "roa", "roi", "eps", "p/e", "debt/equity", "current ratio", "quick ratio", "leverage"],
        [r"[0-9]+\.[0-9]+x", "[0-9]+%", "times", "percent"],
    ),
    "scientific_data": (
        ["experiment", "sample", "control", "mean", "std", "p-value", "significant", "correlation", "n=", "error", "ci", "confidence"],
        [r"p\s*[<=]\s*0\.[0-9]+", r"r\s*=\s*[0-9.-]+", r"n\s*=\s*[0-9]+"],
    ),
    "clinical_trial": (
        ["patient", "placebo", "treatment", "adverse", "efficacy", "safety", "endpoint", "phase", "randomized", "double-blind"],
        [r"phase\s+[123]", r"n\s*=\s*[0-9]+", r"%\s*\([^)]+\)"],
    ),
    "market_data": (
        ["price", "volume", "market cap", "shares", "trading", "close", "open", "high", "low", "bid", "ask", "yield"],
        [r"\$[0-9]+\.[0-9]{2}", "[0-9]{1,3}(,[0-9]{3})*"],
    ),
    "esg_metrics": (
        ["carbon", "emissions", "scope", "renewable", "diversity", "governance", "sustainability", "ghg", "co2", "environmental"],
        ["tco2e?", "mwh", "gj", r"scope\s*[123]"],
    ),
    "portfolio_holdings": (["holdings", "position", "weight", "allocation", "security", "cusip", "isin", "sector", "asset class"], [r"[0-9]+\.[0-9]+%"]),
}
#: What a text must contain for a pattern to match at all.
NEEDED = {r"\$[0-9,]+": "$", r"\$[0-9]+\.[0-9]{2}": "$", "[0-9]+%": "%", r"[0-9]+\.[0-9]+%": "%", r"%\s*\([^)]+\)": "%", r"n\s*=\s*[0-9]+": "=", r"r\s*=\s*[0-9.-]+": "="}
KEYWORD_SCORE, HEADER_SCORE, PATTERN_SCORE = 2, 3, 2
GENERAL_TABLE = "general_data"

# Which facets a type has.
CURRENCY_TYPES = ["financial_income", "financial_balance", "financial_cashflow", "market_data"]
UNIT_TYPES = ["financial_income", "financial_balance", "financial_cashflow", "scientific_data"]
STATISTIC_TYPES, PERIOD_TYPES, TICKER_TYPES = ["scientific_data"], ["financial_income"], ["market_data"]

# Currency marks in the order they are tried, and units as patterns in the order they are listed.
CURRENCIES = [("$", "USD"), ("CHF", "CHF"), ("Rs", "INR")]
UNITS = [
    "million", "billion", "thousand", "mn", "bn", "k", "mg/ml", "ng/ml", "mM", "nM", "kDa", "Da", "K",
    "tCO2e?", "MWh", "GWh", "GJ", "TJ", "%", "percent", "bps", "basis points",
]
PERIODS = [r"(Q[1-4])\s*([0-9]{4}|[0-9]{2})", r"(?i)(FY|fiscal year)\s*([0-9]{4}|[0-9]{2})", r"([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})\s*-\s*([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})"]
TICKER, TICKER_LIMIT = r"\b[A-Z]{1,5}\b(?:\.[A-Z]{2})?", 10
NO_TICKERS = ["USD", "EUR", "GBP", "CEO", "CFO", "COO", "IPO", "M&A", "Q1", "Q2", "Q3", "Q4"]

# Words, edge density range, aspect ratio range, and whether many vector drawings speak for a type.
IMAGE_TYPES: dict[str, tuple[list[str], tuple[float, float], tuple[float, float], bool]] = {
    "chart": (["axis", "legend", "data", "series", "%", "chart", "graph", "exhibit", "revenue", "growth", "trend", "performance", "quarterly", "annual"], (0.05, 0.3), (0.5, 2.0), True),
    "diagram": (["flow", "process", "step", "arrow", "box", "workflow", "architecture", "structure", "hierarchy", "relationship"], (0.1, 0.4), (0.3, 3.0), True),
    "infographic": (["infographic", "data", "visualization", "icon", "trend", "statistic", "comparison", "timeline", "fact", "metric"], (0.05, 0.5), (0.3, 3.0), True),
    "table_image": (["table", "row", "column", "cell", "grid", "spreadsheet"], (0.2, 0.6), (0.5, 2.0), False),
    "screenshot": (["screenshot", "window", "interface", "button", "menu", "toolbar", "application", "software", "screen"], (0.1, 0.5), (0.5, 2.0), False),
    "logo": (["logo", "brand", "trademark", "copyright"], (0.0, 0.3), (0.5, 2.0), False),
    "photograph": (["photo", "image", "picture"], (0.0, 0.2), (0.3, 3.0), False),
    "scientific_figure": (["figure", "fig.", "experiment", "result", "scale", "µm", "nm", "microscopy", "gel", "blot", "staining", "fluorescence"], (0.05, 0.4), (0.5, 2.0), False),
}
WORD_SCORE, EDGE_SCORE, ASPECT_SCORE, VECTOR_SCORE, MANY_VECTORS = 2.0, 1.0, 0.5, 3.0, 50
GENERAL_IMAGE = "general_image"
CHARTS = [("bar_chart", ["bar", "column"]), ("line_chart", ["line", "trend"]), ("pie_chart", ["pie", "donut"]), ("scatter_plot", ["scatter", "bubble"]), ("heatmap", ["heat"])]
DIAGRAMS = [("flowchart", ["flow"]), ("process_diagram", ["process"]), ("architecture_diagram", ["architecture"])]
FIGURES = [("western_blot", ["western", "blot"]), ("microscopy", ["microscopy", "magnification"]), ("gel_electrophoresis", ["gel"])]
SCALE = "([0-9]+)\\s*(µm|nm|mm|cm)"
CAPTION, REFERENCE, EXHIBIT = r"(?i)(Figure|Fig\.|Figure\.|Exhibit)\s*[0-9]+", r"(?i)(Figure|Fig\.?|Exhibit)\s*([0-9]+)", r"(?i)Exhibit\s*[0-9]+"
