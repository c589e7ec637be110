"""Word lists, weights and lookup tables that results depend on.

All of them are defaults; the operators take other dictionaries as parameters.
"""

# Categories of feed articles and their keywords, in tie-break order.
FEED_CATEGORIES = {
    "earnings": ["earnings", "eps", "revenue", "quarter", "results", "guidance", "forecast", "profit", "loss",
                 "beat", "miss"],
    "analyst": ["upgrade", "downgrade", "price target", "rating", "initiated", "reiterate", "analyst"],
    "management": ["ceo", "cfo", "board", "resigns", "appoints", "executive", "leadership"],
    "corporate": ["acquisition", "merger", "buyback", "dividend", "split", "deal", "partnership", "expansion"],
    "filing": ["13f", "stake", "holdings", "llc increases", "llc reduces", "management purchased",
               "increases position", "reduces position", "institutional", "buys shares", "sells shares",
               "buys new shares", "new position in"],
    "regulation": ["sec", "lawsuit", "settlement", "investigation", "fine", "penalty", "compliance"],
}

# Categories of tabular news rows and their keywords, in tie-break order.
NEWS_CATEGORIES = {
    "earnings": ["earnings", "eps", "revenue", "quarter", "results", "guidance"],
    "analyst": ["upgrade", "downgrade", "price target", "rating", "analyst"],
    "management": ["ceo", "cfo", "board", "executive"],
    "corporate": ["acquisition", "merger", "buyback", "dividend", "deal"],
    "regulation": ["sec", "lawsuit", "investigation", "penalty"],
}

# Research-note categories: the first one with a matching keyword wins.
NOTE_CATEGORIES = {
    "Earnings & Financials": ["earnings", "revenue", "profit", "margin", "eps", "financial", "quarterly", "forecast",
                              "guidance", "balance sheet", "net income", "sales", "dividend"],
    "Operations & Deliveries": ["production", "delivery", "deliveries", "factory", "plant", "operations",
                                "supply chain", "logistics", "manufacturing", "inventory", "gigafactory"],
    "Regulation & Legal": ["lawsuit", "sued", "regulation", "regulator", "court", "legal", "compliance", "ban",
                           "investigation", "fines", "recall", "safety", "sec"],
    "Innovation / AI / Growth": ["ai", "artificial intelligence", "innovation", "technology", "tech", "growth",
                                 "expansion", "new product", "launch", "robot", "fsd", "autopilot", "optimus",
                                 "dojo", "cybercab"],
    "Energy & Growth": ["energy", "solar", "battery", "storage", "expansion", "megapack", "powerwall", "renewable",
                        "clean energy"],
    "Competition & Market Pressure": ["competition", "rival", "competitor", "market share", "price cut", "pressure",
                                      "macro", "inflation", "rates", "interest rate", "demand", "analyst",
                                      "downgrade", "upgrade", "price target"],
    "Management & Strategy": ["ceo", "management", "strategy", "executive", "board", "hire", "fire", "layoff",
                              "shareholder", "vote", "acquisition", "merger"],
}

KEEP_CATEGORIES = ["earnings", "analyst", "management", "corporate", "regulation"]
DISCARD_CATEGORIES = ["filing"]

# Order in which category quotas are filled.
QUOTA_PRIORITY = ["earnings", "analyst", "corporate", "management", "regulation", "general"]

# Points a category adds to an article's score.
CATEGORY_POINTS = {
    "earnings": 4,
    "analyst": 4,
    "management": 3,
    "corporate": 3,
    "regulation": 2,
    "filing": -8,
}

# Buckets counted per day; other categories count as general.
SIGNAL_BUCKETS = ["earnings", "analyst", "management", "corporate", "regulation", "general"]

OWNERSHIP_SPAM = [
    "buys shares", "sells shares", "buys new shares", "increases holdings",
    "reduces holdings", "new position in", "llc buys", "llc sells",
    "advisors buys", "advisors sells", "management increases", "management reduces",
    "grows stock holdings", "raises stock position", "sells 4,", "sells 3,", "sells 2,", "sells 1,",
]

NOISE_WORDS = [
    "weather", "storm", "hurricane", "flood", "tornado", "freeze", "snow",
    "shooting", "murder", "crime", "arrest", "police",
    "war", "military", "invasion", "troops", "missile", "ukraine", "russia",
    "election", "vote", "congress", "senate", "democrat", "republican", "trump", "biden",
    "sports", "game", "celebrity", "movie", "concert", "nfl", "nba",
    "airline delays", "flight cancel", "airport",
    "bitcoin price", "crypto crash", "meme coin",
]

IMPACT_WORDS = [
    "earnings", "revenue", "guidance", "quarter", "profit", "loss",
    "upgrade", "downgrade", "beat", "miss", "forecast", "outlook",
    "acquisition", "merger", "buyback", "dividend", "split",
    "sec", "filing", "lawsuit", "settlement", "investigation",
    "ceo", "cfo", "executive", "board", "analyst",
]

FINANCE_WORDS = ["stock", "shares", "earnings", "revenue", "market", "sec", "ipo", "deal", "acquire"]

# Source substrings and their weight; the first match wins.
SOURCE_WEIGHTS = {
    "reuters": 5,
    "wsj": 5,
    "ft.com": 5,
    "bloomberg": 5,
    "cnbc": 4,
    "seekingalpha": 3,
    "yahoo": 3,
    "benzinga": 2,
    "marketwatch": 2,
    "nasdaq": 2,
    "stocktwits": 0,
    "google": 1,
}

# Words left out of headline frequencies.
HEADLINE_STOPWORDS = [
    "the", "and", "for", "with", "after", "today", "stock", "market",
    "from", "this", "that", "why", "how", "are", "as", "over",
]

# Company keywords that keep a listed article.
TICKER_KEYWORDS = {
    "TSLA": ["tesla", "elon musk", "ev", "robotaxi"],
    "NVDA": ["nvidia", "gpu", "ai"],
    "AAPL": ["apple", "iphone", "ios"],
    "AMD": ["amd", "ryzen", "chip"],
    "AMZN": ["amazon", "aws"],
    "MSFT": ["microsoft", "azure"],
    "GOOGL": ["google", "alphabet"],
    "META": ["meta", "facebook"],
    "BAC": ["bank of america", "bofa"],
    "INTC": ["intel", "chip"],
    "CSCO": ["cisco", "network"],
    "KO": ["coca cola"],
    "XOM": ["exxon", "oil"],
    "NFLX": ["netflix"],
    "NKE": ["nike", "sneaker"],
}

# Symbols used when no listing can be read.
FALLBACK_SYMBOLS = [
    "TSLA", "NVDA", "AAPL", "AMD", "PLTR", "AMZN", "MSFT", "GOOGL", "META", "F",
    "BAC", "T", "INTC", "CSCO", "CMCSA", "PFE", "VZ", "WFC", "KO", "XOM",
    "DIS", "NFLX", "NKE", "JPM", "V",
]

# Class number of each signal label; unknown labels count as Neutral.
LABEL_INDEX = {
    "Strong Bullish": 0,
    "Bullish": 0,
    "Neutral": 1,
    "Bearish": 2,
    "Strong Bearish": 2,
}
CLASS_NAMES = ["Bullish", "Neutral", "Bearish"]

# Columns of a news table, in file order.
NEWS_COLUMNS = ["ticker", "company", "source", "title", "summary", "published", "url", "scraped_at"]
