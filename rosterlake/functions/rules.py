"""Dictionaries of the profile domain. All lists are fixed values in the order in which they are tried."""

from __future__ import annotations

# Canonical companies and their known variants.
COMPANY_VARIANTS = {
    "google": ["google", "google inc", "google llc", "alphabet", "alphabet inc"],
    "meta": ["meta", "facebook", "facebook inc", "fb", "meta platforms"],
    "amazon": ["amazon", "amazon.com", "amazon inc", "amazon web services", "aws"],
    "apple": ["apple", "apple inc", "apple computer"],
    "netflix": ["netflix", "netflix inc"],
    "microsoft": ["microsoft", "microsoft corp", "microsoft corporation", "msft"],
    "goldman sachs": ["goldman sachs", "goldman", "gs", "goldman sachs & co"],
    "morgan stanley": ["morgan stanley", "ms", "morgan stanley & co"],
    "jp morgan": ["jp morgan", "jpmorgan", "jpmorgan chase", "jpm", "jp morgan chase"],
    "bank of america": ["bank of america", "bofa", "boa", "bank of america merrill lynch", "baml"],
    "citigroup": ["citigroup", "citi", "citibank", "citicorp"],
    "mckinsey": ["mckinsey", "mckinsey & company", "mckinsey and company"],
    "bain": ["bain", "bain & company", "bain and company"],
    "bcg": ["bcg", "boston consulting group", "the boston consulting group"],
    "blackstone": ["blackstone", "the blackstone group", "blackstone group"],
    "kkr": ["kkr", "kohlberg kravis roberts", "kkr & co"],
    "carlyle": ["carlyle", "the carlyle group", "carlyle group"],
}
# Patterns applied in order to a company name in lower case.
COMPANY_PATTERNS = [(r"\s+(inc|incorporated|corp|corporation|llc|ltd|limited|co\.?|company)\.?$", ""), (r"^the\s+", ""), (r"\s+&\s+", " and "), (r"\s+", " ")]
# Canonical places and their known variants.
LOCATION_VARIANTS = {
    "new york": ["new york", "new york city", "nyc", "ny", "new york, ny", "manhattan"],
    "san francisco": ["san francisco", "sf", "san francisco, ca", "san francisco bay area"],
    "los angeles": ["los angeles", "la", "los angeles, ca", "l.a."],
    "chicago": ["chicago", "chicago, il", "chi town"],
    "boston": ["boston", "boston, ma", "bos"],
    "washington dc": ["washington dc", "washington, dc", "dc", "washington d.c.", "district of columbia"],
    "london": ["london", "london, uk", "london, england", "london, united kingdom"],
    "hong kong": ["hong kong", "hk", "hong kong sar"],
    "singapore": ["singapore", "sg", "singapore, singapore"],
}
COUNTRY_SUFFIX = r",?\s*(usa|united states|u\.s\.|us)$"
# Words of rank and their level.
SENIORITY = {
    "intern": 1, "junior": 2, "associate": 3, "analyst": 3, "senior analyst": 4, "manager": 5, "senior manager": 6, "director": 7,
    "senior director": 8, "vp": 9, "vice president": 9, "svp": 10, "senior vice president": 10, "evp": 11, "executive vice president": 11,
    "partner": 12, "managing director": 12, "md": 12, "principal": 12, "founder": 13, "ceo": 14, "cto": 14, "cfo": 14, "coo": 14, "president": 14,
}
# Patterns tried where no word of rank occurs.
SENIORITY_PATTERNS = [(r"\b(senior|sr\.?)\s+\w+", "senior", 4), (r"\b(junior|jr\.?)\s+\w+", "junior", 2), (r"\b(lead|principal|staff)\s+\w+", "lead", 6), (r"\bhead\s+of\b", "head", 8)]
# Role types by keyword.
ROLE_TYPES = {
    "engineering": ["engineer", "developer", "programmer", "architect", "swe", "dev"],
    "data": ["data scientist", "data analyst", "data engineer", "ml engineer", "machine learning"],
    "product": ["product manager", "pm", "product owner", "product lead"],
    "design": ["designer", "ux", "ui", "user experience", "creative director"],
    "business": ["business analyst", "strategy", "operations", "business development"],
    "finance": ["analyst", "associate", "investment", "trading", "portfolio", "fund"],
    "consulting": ["consultant", "advisor", "advisory"],
    "sales": ["sales", "account executive", "business development", "bd"],
    "marketing": ["marketing", "growth", "brand", "communications"],
    "legal": ["lawyer", "attorney", "counsel", "legal"],
    "hr": ["hr", "human resources", "recruiting", "talent", "people ops"],
}
# Specialisations by keyword.
SPECIALIZATIONS = {
    "backend": ["backend", "back-end", "server", "api", "infrastructure"],
    "frontend": ["frontend", "front-end", "ui", "react", "angular", "vue"],
    "fullstack": ["fullstack", "full-stack", "full stack"],
    "mobile": ["mobile", "ios", "android", "react native"],
    "devops": ["devops", "sre", "infrastructure", "platform", "cloud"],
    "security": ["security", "cybersecurity", "infosec"],
    "blockchain": ["blockchain", "crypto", "web3", "defi"],
    "ai_ml": ["ai", "ml", "machine learning", "deep learning", "nlp"],
}
# Departments and industry focus by keyword.
DEPARTMENTS = {
    "engineering": ["engineering", "technology", "tech", "it"], "product": ["product", "pm"], "finance": ["finance", "accounting", "treasury"],
    "marketing": ["marketing", "growth", "brand"], "sales": ["sales", "business development"],
}
INDUSTRY_FOCUS = {
    "investment_banking": ["investment banking", "ib", "capital markets"], "private_equity": ["private equity", "pe", "buyout"],
    "venture_capital": ["venture capital", "vc", "venture"], "hedge_fund": ["hedge fund", "hf", "trading"],
}
# Abbreviations of job titles, expanded in order.
TITLE_ABBREVIATIONS = {
    "swe": "software engineer", "sde": "software development engineer", "pm": "product manager", "tpm": "technical program manager",
    "em": "engineering manager", "vp": "vice president", "svp": "senior vice president", "evp": "executive vice president",
    "md": "managing director", "ib": "investment banking", "pe": "private equity", "vc": "venture capital", "hf": "hedge fund", "bd": "business development",
}
# Words left out of the tokens of a title.
TITLE_STOPWORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with"]
# Metropolitan areas: name, state, cities.
METROS = [
    ("San Francisco Bay Area", "California", ["san francisco", "sf", "oakland", "san jose", "berkeley", "palo alto", "mountain view", "menlo park", "redwood city", "sunnyvale", "cupertino", "fremont"]),
    ("New York City Metro", "New York", ["new york", "nyc", "manhattan", "brooklyn", "queens", "bronx", "staten island", "jersey city", "newark"]),
    ("Los Angeles Metro", "California", ["los angeles", "la", "santa monica", "pasadena", "long beach", "glendale", "burbank", "beverly hills", "culver city"]),
    ("Chicago Metro", "Illinois", ["chicago", "evanston", "oak park", "schaumburg", "naperville"]),
    ("Boston Metro", "Massachusetts", ["boston", "cambridge", "somerville", "brookline", "newton"]),
]
# Places abroad: city, country, variants.
ABROAD = [
    ("London", "United Kingdom", ["london", "london uk", "london england", "city of london"]), ("Hong Kong", "Hong Kong", ["hong kong", "hk", "hong kong sar"]),
    ("Singapore", "Singapore", ["singapore", "sg"]), ("Tokyo", "Japan", ["tokyo", "tokyo japan"]), ("Paris", "France", ["paris", "paris france"]),
    ("Dubai", "United Arab Emirates", ["dubai", "dubai uae", "dxb"]), ("Toronto", "Canada", ["toronto", "toronto canada", "gta"]),
    ("Sydney", "Australia", ["sydney", "sydney australia"]), ("Mumbai", "India", ["mumbai", "bombay", "mumbai india"]), ("Shanghai", "China", ["shanghai", "shanghai china"]),
]
# Abbreviations of states.
STATES = {
    "ca": "California", "ny": "New York", "tx": "Texas", "fl": "Florida", "il": "Illinois", "pa": "Pennsylvania", "oh": "Ohio", "ga": "Georgia",
    "nc": "North Carolina", "mi": "Michigan", "nj": "New Jersey", "va": "Virginia", "wa": "Washington", "ma": "Massachusetts", "az": "Arizona",
    "in": "Indiana", "tn": "Tennessee", "mo": "Missouri", "md": "Maryland", "wi": "Wisconsin", "co": "Colorado", "mn": "Minnesota",
    "sc": "South Carolina", "al": "Alabama", "la": "Louisiana", "ky": "Kentucky", "or": "Oregon", "ok": "Oklahoma", "ct": "Connecticut", "ut": "Utah",
    "nv": "Nevada", "dc": "District Of Columbia",
}
# The second rule set: first class with a keyword wins.
RULES_SENIORITY = {
    "intern": ["intern", "internship", "co-op", "coop"], "entry": ["associate", "junior", "entry", "entry-level", "trainee", "graduate"],
    "mid": ["analyst", "specialist", "coordinator", "representative"], "senior": ["senior", "sr", "lead", "principal", "staff"],
    "management": ["manager", "mgr", "supervisor", "head", "team lead", "team leader"], "director": ["director", "dir", "vp", "vice president", "executive"],
    "c-level": ["ceo", "cto", "cfo", "coo", "chief", "president", "founder", "co-founder"],
}
RULES_ROLE = {
    "engineering": ["engineer", "developer", "programmer", "architect", "devops", "sre"], "product": ["product manager", "product owner", "pm", "product analyst"],
    "design": ["designer", "ux", "ui", "creative", "art director"], "data": ["data scientist", "data analyst", "data engineer", "ml engineer"],
    "sales": ["sales", "account manager", "business development", "bd"], "marketing": ["marketing", "brand", "content", "social media", "growth"],
    "operations": ["operations", "ops", "program manager", "project manager"], "finance": ["analyst", "associate", "banker", "trader", "risk"],
    "consulting": ["consultant", "advisor", "strategist"], "research": ["researcher", "scientist", "analyst", "associate researcher"],
}
RULES_SPECIALIZATION = {
    "backend": ["backend", "back-end", "server", "api", "microservices"], "frontend": ["frontend", "front-end", "ui", "react", "angular", "vue"],
    "fullstack": ["fullstack", "full-stack", "full stack"], "mobile": ["mobile", "ios", "android", "react native", "flutter"],
    "machine_learning": ["machine learning", "ml", "ai", "deep learning", "nlp"], "data_science": ["data science", "analytics", "statistics", "modeling"],
    "devops": ["devops", "infrastructure", "cloud", "aws", "kubernetes"], "security": ["security", "cybersecurity", "infosec", "penetration"],
    "blockchain": ["blockchain", "crypto", "web3", "defi", "nft"],
}
RULES_DEPARTMENT = {
    "engineering": ["engineering", "technology", "tech", "development"], "product": ["product", "product management"], "design": ["design", "creative", "user experience"],
    "data": ["data", "analytics", "business intelligence"], "sales": ["sales", "revenue", "business development"], "marketing": ["marketing", "brand", "communications"],
    "operations": ["operations", "ops", "program management"], "finance": ["finance", "accounting", "treasury", "fp&a"], "hr": ["human resources", "hr", "people", "talent"],
    "legal": ["legal", "compliance", "regulatory"],
}
RULES_INDUSTRY = {
    "fintech": ["fintech", "financial technology", "payments", "banking"], "healthcare": ["healthcare", "medical", "biotech", "pharma"],
    "ecommerce": ["ecommerce", "e-commerce", "retail", "marketplace"], "saas": ["saas", "software as a service", "b2b software"],
    "consumer": ["consumer", "b2c", "social media", "entertainment"], "enterprise": ["enterprise", "b2b", "business software"],
    "gaming": ["gaming", "games", "entertainment", "mobile games"], "edtech": ["edtech", "education", "learning", "training"],
    "proptech": ["proptech", "real estate", "property"], "logistics": ["logistics", "supply chain", "transportation"],
}
RULES_WEIGHTS = {"seniority": 0.2, "role_type": 0.3, "specialization": 0.2, "department": 0.2, "industry_focus": 0.1}
RULES_ABBREVIATIONS = {"sr": "senior", "jr": "junior", "mgr": "manager", "dir": "director", "vp": "vice president", "swe": "software engineer", "pm": "product manager", "qa": "quality assurance"}
# Terms of time and boilerplate.
TEMPORAL_TERMS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
    "december", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec", "present", "current",
    "ongoing", "now", "today", "year", "years", "month", "months", "week", "weeks", "day", "days",
    "responsibilities", "duties", "tasks", "role", "position", "responsible", "managed", "led", "oversaw",
    "coordinated", "worked", "experience", "background", "including", "such", "as", "various", "multiple", "several",
    "different", "range", "wide", "broad", "diverse", "extensive", "comprehensive", "the", "a", "an", "and", "or",
    "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about", "into", "through", "during",
    "before", "after", "above", "below", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine",
    "ten", "eleven", "twelve", "twenty", "thirty", "summer", "fall", "spring", "winter", "semester", "quarter",
    "internship", "intern", "co-op", "temporary", "temp", "contract", "part-time", "full-time", "freelance",
    "volunteer",
]
# Patterns of dates, blanked in order.
DATE_PATTERNS = [r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", r"\b\d{1,2}-\d{1,2}-\d{2,4}\b", r"\b\d{4}-\d{1,2}-\d{1,2}\b", r"\b\d{1,2}\s+\d{4}\b", r"\b\d{4}\b"]
# Weights of term types, and pairs that are passed over.
TERM_WEIGHTS = {"title": 3.0, "company": 2.0, "seniority": 2.0, "role": 2.0, "spec": 1.5, "industry": 1.5, "skill": 1.0, "location": 0.5, "dept": 0.5}
GENERIC_TERMS = ["role:other", "spec:general", "industry:general", "location:other"]
# Domains of queries.
DOMAINS = {
    "finance": {
        "primary": ["finance", "financial", "investment", "banking", "capital"],
        "companies": ["goldman sachs", "morgan stanley", "jp morgan", "jpmorgan", "citadel", "blackstone", "kkr", "apollo", "bridgewater"],
        "roles": ["investment banker", "analyst", "associate", "vice president", "managing director", "portfolio manager", "research analyst", "trader", "quant"],
        "keywords": ["wall street", "private equity", "venture capital", "hedge fund", "asset management", "securities", "derivatives", "equity", "debt"],
    },
    "technology": {
        "primary": ["technology", "tech", "software", "engineer", "developer"],
        "companies": ["google", "meta", "microsoft", "amazon", "apple", "netflix", "uber"],
        "roles": ["software engineer", "data scientist", "product manager", "engineering manager"],
        "keywords": ["programming", "coding", "machine learning", "ai", "data analysis"],
    },
    "consulting": {
        "primary": ["consulting", "consultant", "advisory", "strategy"],
        "companies": ["mckinsey", "bain", "bcg", "deloitte", "pwc", "accenture"],
        "roles": ["consultant", "senior consultant", "principal", "partner"],
        "keywords": ["management consulting", "strategy consulting", "business analyst"],
    },
}
DOMAIN_WEIGHTS = {"primary": 3.0, "companies": 4.0, "roles": 3.5, "keywords": 2.0}
# Phrases that are kept whole.
PHRASES = {
    "wall st": "wall street", "wall st.": "wall street", "wall street": "wall street", "investment bank": "investment banking", "investment banking": "investment banking",
    "private equity": "private equity", "venture capital": "venture capital", "hedge fund": "hedge fund", "asset management": "asset management",
    "goldman sachs": "goldman sachs", "morgan stanley": "morgan stanley", "jp morgan": "jp morgan", "jpmorgan": "jp morgan", "software engineer": "software engineer",
    "data scientist": "data scientist", "machine learning": "machine learning", "artificial intelligence": "artificial intelligence", "product manager": "product manager",
    "management consulting": "management consulting", "strategy consulting": "strategy consulting", "mckinsey company": "mckinsey", "bain company": "bain",
    "boston consulting": "bcg", "vc banker": "venture capital investment banking", "wall st banker": "wall street investment banking", "wall st vc": "wall street venture capital",
}
# Synonyms of query words (built-in set; a mapping file may replace it).
SYNONYMS = {
    "wall": ["wall street", "finance", "financial", "investment banking", "banking", "goldman", "morgan"], "st": ["street", "wall street", "finance", "financial"],
    "vc": ["venture capital", "venture", "capital", "investment", "startup", "private equity"], "banker": ["investment banker", "banking", "finance", "financial", "investment banking", "goldman", "morgan"],
    "investment": ["banking", "finance", "financial", "capital", "asset management", "goldman", "morgan"], "banking": ["investment", "finance", "financial", "banker", "wall street", "goldman", "morgan"],
    "goldman": ["goldman sachs", "investment banking", "finance", "wall street", "banking"], "sachs": ["goldman sachs", "goldman", "investment banking", "finance"],
    "morgan": ["morgan stanley", "jp morgan", "jpmorgan", "investment banking", "finance"], "finance": ["financial", "investment", "banking", "capital", "wall street", "goldman", "morgan"],
    "financial": ["finance", "investment", "banking", "capital", "analyst"], "consulting": ["consultant", "mckinsey", "bain", "bcg", "deloitte", "strategy"],
    "mckinsey": ["consulting", "strategy", "management consulting"], "bain": ["consulting", "strategy", "management consulting"], "bcg": ["boston consulting", "consulting", "strategy"],
    "software": ["engineer", "developer", "programming", "tech", "google", "meta"], "engineer": ["software", "developer", "technical", "programming", "google"],
    "data": ["scientist", "analyst", "analysis", "analytics", "machine learning"], "google": ["tech", "technology", "software", "engineer"], "meta": ["facebook", "tech", "technology", "software"],
}
# The guard of finance queries: triggers, and substrings of which one must occur.
FINANCE_TRIGGERS = ["investment", "banking", "finance", "financial", "wall street"]
FINANCE_FIELD_TERMS = [*FINANCE_TRIGGERS, "goldman", "morgan"]
FINANCE_PHRASE_HINTS = ["wall st", "wall street", "vc", "banker", "investment"]
FINANCE_GUARD = {
    "industry": ["finance", "banking", "investment"], "function": ["finance"], "current_position": ["investment", "banking", "analyst", "associate"],
    "current_company": ["goldman", "morgan", "jpmorgan", "citadel", "blackstone"],
}
# Companies whose colleagues count for more.
TIER1 = ["google", "apple", "microsoft", "amazon", "meta", "facebook", "goldman sachs", "morgan stanley", "jpmorgan", "blackstone", "mckinsey", "bain", "bcg", "deloitte"]
# Entity patterns of free-text queries.
QUERY_PATTERNS = {
    "companies": [r"\b(?:at|@|from|with)\s+([A-Z][A-Za-z\s&]+)", r"\b([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*)\s+(?:alumni|alum|people)", r"\b(?:work(?:s|ed|ing)?\s+(?:at|for))\s+([A-Z][A-Za-z\s&]+)"],
    "titles": [r"\b(software\s+engineer(?:ing)?|swe)\b", r"\b(product\s+manager|pm)\b", r"\b(data\s+scientist|data\s+analyst)\b", r"\b(investment\s+bank(?:er|ing)|ib)\b", r"\b(private\s+equity|pe)\b", r"\b(consult(?:ant|ing))\b", r"\b(analyst|associate|vp|vice\s+president|director|manager)\b"],
    "locations": [r"\b(?:in|from|based\s+in)\s+([A-Z][A-Za-z\s]+)", r"\b(new\s+york|nyc|ny|san\s+francisco|sf|bay\s+area|london|hong\s+kong)\b"],
    "seniority": [r"\b(junior|senior|lead|principal|staff|entry\s+level|experienced)\b", r"\b(intern|associate|manager|director|vp|executive)\b"],
    "experience_years": [r"(\d+)\+?\s*(?:years?|yrs?)\s*(?:of\s+)?experience", r"(?:with\s+)?(?:at\s+least\s+)?(\d+)\s*(?:years?|yrs?)"],
    "education": [r"\b(yale|harvard|stanford|mit|princeton|columbia)\b", r"\b(ba|bs|mba|phd|masters?|bachelors?)\b", r"\b(computer\s+science|cs|economics|finance|engineering)\b"],
}
QUERY_CONSTRAINTS = {"current": r"\b(?:current|currently|now)\b", "former": r"\b(?:former|previously|ex-|past)\b", "recent": r"\b(?:recent|recently|last\s+\d+\s+years?)\b", "senior_only": r"\b(?:senior|experienced|seasoned)\s+(?:only|professionals?)\b"}
QUERY_ABBREVIATIONS = {"swe": "software engineer", "pm": "product manager", "ib": "investment banking", "pe": "private equity", "vc": "venture capital", "hf": "hedge fund", "ml": "machine learning", "ai": "artificial intelligence"}
QUERY_STOPWORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "about", "as", "who", "what", "when", "where", "how", "which", "that", "find", "search", "looking", "need", "want", "show", "get"]
# Words of a query that are not looked up in the term graph.
GRAPH_STOPWORDS = ["and", "or", "the", "a", "an", "in", "at", "to", "for", "with"]
# Weights of the additive score, and of the normalised one.
LEGACY_WEIGHTS = {"exact_title": 10.0, "exact_company": 8.0, "normalized_title": 6.0, "normalized_company": 5.0, "expanded": 3.0, "skill": 2.0, "experience": 2.0, "seniority": 1.5, "location": 1.0, "recency": 2.0, "education": 1.0}
SCORE_WEIGHTS = {"exact": 0.4, "semantic": 0.3, "cooccurrence": 0.3}
EXACT_WEIGHTS = {"title": 0.4, "company": 0.3, "skills": 0.2, "experience": 0.1}
