"""Lookup values the results depend on.

Everything under the FIXED VALUES banner must equal the values used by the
system this engine reproduces (keyword lists, ministry names, stop words,
skip words, thresholds); they are stated once, in their natural order, and
every operator reads them from here.  Values below the OWN DEFAULTS banner
are this engine's own choices for parts that the original delegated to
third-party packages (contractions, polarity lexicon, lemmas); callers can
replace each of them with their own table.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the original behaviour)
# ---------------------------------------------------------------------------

# Gold-layer keyword classifier: category -> keywords, in declaration order.
# Declaration order is also the tie-break order (first category wins).
KEYWORD_MAP: dict[str, list[str]] = {
    "Sports": ["cricket", "football", "match", "player", "team", "sport", "olympic",
               "tournament", "goal", "wicket", "ipl", "fifa", "tennis", "hockey",
               "batsman", "bowler", "innings", "stadium", "league", "medal", "coach"],
    "Politics": ["minister", "parliament", "election", "political", "government", "bjp",
                 "congress", "vote", "campaign", "modi", "opposition", "bill", "policy",
                 "president", "prime minister", "lok sabha", "rajya sabha", "mla", "rally"],
    "Business": ["market", "stock", "economy", "company", "profit", "revenue", "trade",
                 "investment", "gdp", "inflation", "rbi", "bank", "startup", "ipo",
                 "sensex", "nifty", "rupee", "share", "fiscal", "budget", "tax"],
    "Technology": ["technology", "software", "app", "digital", "ai", "artificial",
                   "computer", "internet", "cyber", "tech", "google", "apple", "robot",
                   "smartphone", "data", "chip", "5g", "cloud", "elon musk", "tesla"],
    "Entertainment": ["movie", "film", "bollywood", "actor", "actress", "celebrity",
                      "music", "song", "album", "award", "netflix", "series", "show",
                      "director", "box office", "trailer", "ott", "dance", "hollywood"],
    "Crime": ["murder", "arrested", "police", "crime", "theft", "robbery", "fraud",
              "accused", "suspect", "criminal", "jail", "prison", "investigation",
              "kidnap", "assault", "drug", "scam", "fir", "rape", "encounter"],
    "Judiciary": ["court", "judge", "verdict", "supreme", "high court", "petition",
                  "hearing", "bail", "lawyer", "legal", "judicial", "bench",
                  "constitution", "appeal", "acquit", "convict", "pil"],
    "International": ["us ", "china", "pakistan", "russia", "ukraine", "united nations",
                      "global", "world", "foreign", "international", "nato", "eu ",
                      "biden", "trump", "iran", "israel", "gaza", "britain", "canada"],
    "Science": ["science", "research", "nasa", "isro", "space", "discovery",
                "scientist", "study", "experiment", "climate", "environment",
                "vaccine", "health", "disease", "medical", "virus", "earthquake"],
    "Culture": ["culture", "festival", "tradition", "heritage", "temple", "religion",
                "art", "museum", "dance", "diwali", "eid", "christmas", "holi",
                "spiritual", "pilgrim", "ancient", "yoga"],
}

# Offline (workspace) keyword classifier: the smaller map, same rule.
KEYWORD_MAP_SMALL: dict[str, list[str]] = {
    "Sports": ["cricket", "football", "match", "player", "team", "sport", "olympic",
               "tournament", "goal", "wicket", "ipl", "fifa", "tennis", "hockey"],
    "Politics": ["minister", "parliament", "election", "political", "government", "bjp",
                 "congress", "vote", "campaign", "modi", "rahul", "opposition", "bill"],
    "Business": ["market", "stock", "economy", "company", "profit", "revenue", "trade",
                 "investment", "gdp", "inflation", "rbi", "bank", "startup", "ipo"],
    "Technology": ["technology", "software", "app", "digital", "ai", "artificial",
                   "computer", "internet", "cyber", "tech", "google", "apple", "robot"],
    "Entertainment": ["movie", "film", "bollywood", "actor", "actress", "celebrity",
                      "music", "song", "album", "award", "netflix", "series", "show"],
    "Crime": ["murder", "arrested", "police", "crime", "theft", "robbery", "fraud",
              "accused", "suspect", "criminal", "jail", "prison", "investigation"],
    "Judiciary": ["court", "judge", "verdict", "supreme", "high court", "petition",
                  "hearing", "bail", "lawyer", "legal", "judicial", "bench"],
    "International": ["us ", "china", "pakistan", "russia", "ukraine", "united nations",
                      "global", "world", "foreign", "international", "nato", "eu "],
    "Science": ["science", "research", "nasa", "isro", "space", "discovery",
                "scientist", "study", "experiment", "climate", "environment"],
    "Culture": ["culture", "festival", "tradition", "heritage", "temple", "religion",
                "art", "museum", "dance", "diwali", "eid", "christmas"],
}

DEFAULT_CATEGORY = "Politics"

# Category -> responsible ministry; unknown categories map to themselves.
MINISTRY_MAP: dict[str, str] = {
    "Sports": "Ministry of Youth Affairs and Sports",
    "Culture": "Ministry of Culture",
    "International": "Ministry of External Affairs",
    "Politics": "Ministry of Home Affairs",
    "Science": "Ministry of Science and Technology",
    "Technology": "Ministry of Electronics and IT",
    "Business": "Ministry of Finance",
    "Entertainment": "Ministry of Information and Broadcasting",
    "Judiciary": "Ministry of Law and Justice",
    "Crime": "Department of Internal Security",
}

# Transformer classifier output index -> category name.
MODEL_CATEGORIES: list[str] = [
    "Entertainment", "Business", "Politics", "Judiciary", "Crime",
    "Culture", "Sports", "Science", "International", "Technology",
]

# Sentiment model label map (id, label), as in the shipped tab-separated file.
SENTIMENT_LABELS: list[str] = ["negative", "neutral", "positive"]

# Silver-layer stop words (151 words; "not" is not among them).
SILVER_STOPWORDS: list[str] = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your",
    "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her",
    "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs",
    "themselves", "what", "which", "who", "whom", "this", "that", "these", "those",
    "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if",
    "or", "because", "as", "until", "while", "of", "at", "by", "for", "with",
    "about", "against", "between", "through", "during", "before", "after", "above",
    "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under",
    "again", "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "both", "each", "few", "more", "most", "other", "some", "such",
    "no", "nor", "only", "own", "same", "so", "than", "too", "very", "s", "t",
    "can", "will", "just", "don", "should", "now", "d", "ll", "m", "o", "re", "ve",
    "y", "ain", "aren", "couldn", "didn", "doesn", "hadn", "hasn", "haven", "isn",
    "ma", "mightn", "mustn", "needn", "shan", "shouldn", "wasn", "weren", "won",
    "wouldn", "any",
]

# English stop words of the workspace cleaners (the classic 179-word list;
# the English cleaner keeps "not", the Hindi cleaner drops it too).
ENGLISH_STOPWORDS: list[str] = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're",
    "you've", "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he", "him",
    "his", "himself", "she", "she's", "her", "hers", "herself", "it", "it's", "its",
    "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who",
    "whom", "this", "that", "that'll", "these", "those", "am", "is", "are", "was",
    "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did",
    "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until",
    "while", "of", "at", "by", "for", "with", "about", "against", "between", "into",
    "through", "during", "before", "after", "above", "below", "to", "from", "up",
    "down", "in", "out", "on", "off", "over", "under", "again", "further", "then",
    "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each",
    "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own",
    "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "don't",
    "should", "should've", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren",
    "aren't", "couldn", "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn",
    "hadn't", "hasn", "hasn't", "haven", "haven't", "isn", "isn't", "ma", "mightn",
    "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't", "shouldn",
    "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
]

# Hindi stop words of the Hindi cleaner, plus the listed symbol tokens.
HINDI_STOPWORDS: list[str] = [
    'तुम', 'मेरी', 'मुझे', 'क्योंकि', 'हम', 'प्रति', 'अबकी', 'आगे', 'माननीय',
    'शहर', 'बताएं', 'कौनसी', 'क्लिक', 'किसकी', 'बड़े', 'मैं', 'and', 'रही', 'आज',
    'लें', 'आपके', 'मिलकर', 'सब', 'मेरे', 'जी', 'श्री', 'वैसा', 'आपका', 'अंदर',
    'अत', 'अपना', 'अपनी', 'अपने', 'अभी', 'आदि', 'आप', 'इत्यादि', 'इन', 'इनका',
    'इन्हीं', 'इन्हें', 'इन्हों', 'इस', 'इसका', 'इसकी', 'इसके', 'इसमें', 'इसी',
    'इसे', 'उन', 'उनका', 'उनकी', 'उनके', 'उनको', 'उन्हीं', 'उन्हें', 'उन्हों',
    'उस', 'उसके', 'उसी', 'उसे', 'एक', 'एवं', 'एस', 'ऐसे', 'और', 'कई', 'कर',
    'करता', 'करते', 'करना', 'करने', 'करें', 'कहते', 'कहा', 'का', 'काफ़ी', 'कि',
    'कितना', 'किन्हें', 'किन्हों', 'किया', 'किर', 'किस', 'किसी', 'किसे', 'की',
    'कुछ', 'कुल', 'के', 'को', 'कोई', 'कौन', 'कौनसा', 'गया', 'घर', 'जब', 'जहाँ',
    'जा', 'जितना', 'जिन', 'जिन्हें', 'जिन्हों', 'जिस', 'जिसे', 'जीधर', 'जैसा',
    'जैसे', 'जो', 'तक', 'तब', 'तरह', 'तिन', 'तिन्हें', 'तिन्हों', 'तिस', 'तिसे',
    'तो', 'था', 'थी', 'थे', 'दबारा', 'दिया', 'दुसरा', 'दूसरे', 'दो', 'द्वारा',
    'न', 'नहीं', 'ना', 'निहायत', 'नीचे', 'ने', 'पर', 'पहले', 'पूरा', 'पे', 'फिर',
    'बनी', 'बही', 'बहुत', 'बाद', 'बाला', 'बिलकुल', 'भी', 'भीतर', 'मगर', 'मानो',
    'मे', 'में', 'यदि', 'यह', 'यहाँ', 'यही', 'या', 'यिह', 'ये', 'रखें', 'रहा',
    'रहे', 'ऱ्वासा', 'लिए', 'लिये', 'लेकिन', 'व', 'वर्ग', 'वह', 'वहाँ', 'वहीं',
    'वाले', 'वुह', 'वे', 'वग़ैरह', 'संग', 'सकता', 'सकते', 'सबसे', 'सभी', 'साथ',
    'साबुत', 'साभ', 'सारा', 'से', 'सो', 'ही', 'हुआ', 'हुई', 'हुए', 'है', 'हैं',
    'हो', 'होता', 'होती', 'होते', 'होना', 'होने',
]
HINDI_SYMBOL_TOKENS: list[str] = [
    'nn', 'n', '।', '/', '`', '+', '\\', '"', '?', '(', '$', '@',
    '[', '_', '!', ',', ':', '^', '|', ']', '=', '%', '&', '.', ')',
    '#', '*', ';', '-', '}',
]

# Devanagari digits 0..9 (translated to ASCII digits, then removed).
DEVANAGARI_DIGITS = "०१२३४५६७८९"

# Show titles dropped from the one Hindi video source (case-sensitive).
HINDI_SHOW_TITLES: list[str] = ["Aaj Ki Baat", "Horoscope", "Aap Ki Adalat"]

# Crawler: links with any path segment equal to one of these are skipped.
CRAWL_SKIP_SEGMENTS: list[str] = [
    "video", "tag", "author", "tags", "livetv", "videos", "web-stories",
    "astrology", "visualstories", "photos", "photo-gallery", "live-tv", "podcast",
]

# Crawled sites: (site rule, start page, host, channel).
SOURCES: list[tuple[str, str, str, str]] = [
    ("toi", "https://timesofindia.indiatimes.com", "timesofindia.indiatimes.com", "TimesOfIndia"),
    ("ht", "https://www.hindustantimes.com", "www.hindustantimes.com", "HindustanTimes"),
    ("thehindu", "https://www.thehindu.com", "www.thehindu.com", "TheHindu"),
    ("indianexpress", "https://indianexpress.com", "indianexpress.com", "IndianExpress"),
    ("indiatoday", "https://www.indiatoday.in", "www.indiatoday.in", "IndiaToday"),
    ("theprint", "https://theprint.in", "theprint.in", "ThePrint"),
    ("et", "https://economictimes.indiatimes.com", "economictimes.indiatimes.com", "EconomicTimes"),
    ("livemint", "https://www.livemint.com", "www.livemint.com", "LiveMint"),
    ("scroll", "https://scroll.in", "scroll.in", "Scroll"),
    ("aajtak", "https://www.aajtak.in", "www.aajtak.in", "AajTak"),
]

# Publish-date sources, in fallback order.
DATE_META_PROPERTIES: list[str] = ["article:published_time", "og:article:published_time"]
DATE_META_NAMES: list[str] = ["publish-date", "date", "pubdate", "publishdate", "original-source"]
DATE_META_NAMES_WORKSPACE: list[str] = ["publish-date", "date", "pubdate", "publishdate", "Date"]

# Thresholds and sizes.
POSITIVE_THRESHOLD = 0.1        # polarity > 0.1 -> positive
NEGATIVE_THRESHOLD = -0.1       # polarity < -0.1 -> negative
ALERT_THRESHOLD = 0.5           # negative_score >= 0.5 -> alert
ALERT_PERCENT = 50.0            # workspace: Negative percent >= 50.0
MIN_BODY_CHARS = 50             # silver: trimmed body length > 50
MIN_CLEAN_CHARS = 10            # silver: cleaned body length > 10
EDITED_BY_SILVER = "Edited By:"
EDITED_BY_WORKSPACE = "Edited By: "
VIDEO_LINK_MIN_CHARS = 60
SCORE_INPUT_CHARS = 1500
MODEL_MAX_TOKENS = 512
TRANSLATE_CHARS = 2300
API_DEFAULT_PER_PAGE = 20
API_MAX_PER_PAGE = 100
FEED_PAGE_SIZE = 15
ALLOWED_SORT = ["negative_score", "positive_score", "article_date"]
DEFAULT_SORT = "article_date"
FOREST_TREES = 100
FOREST_FEATURES = 10000
FOREST_SEED = 42
CHUNK_MS = 10000
BAND_GREEN = 0.6
BAND_AMBER = 0.4

# ---------------------------------------------------------------------------
# OWN DEFAULTS (replaceable; the original used external packages here)
# ---------------------------------------------------------------------------

# English contraction expansions, applied in this order to lower-cased text.
# Apostrophe may be ' or the typographic ’.
CONTRACTIONS: list[tuple[str, str]] = [
    ("won't", "will not"), ("can't", "cannot"), ("shan't", "shall not"),
    ("ain't", "are not"), ("let's", "let us"), ("y'all", "you all"),
    ("it's", "it is"), ("he's", "he is"), ("she's", "she is"), ("that's", "that is"),
    ("what's", "what is"), ("there's", "there is"), ("here's", "here is"),
    ("who's", "who is"), ("where's", "where is"), ("how's", "how is"),
    ("n't", " not"), ("'re", " are"), ("'ve", " have"), ("'ll", " will"),
    ("'m", " am"), ("'d", " would"),
]

# Polarity lexicon: word -> polarity in [-1, 1].  Values are multiples of
# 1/16 so that sums are exact in any order on every engine.
DEFAULT_LEXICON: dict[str, float] = {
    "good": 0.6875, "great": 0.8125, "excellent": 1.0, "best": 1.0, "better": 0.5,
    "happy": 0.8125, "success": 0.3125, "successful": 0.75, "win": 0.5, "wins": 0.5,
    "victory": 0.5, "growth": 0.25, "improve": 0.25, "improved": 0.3125,
    "positive": 0.25, "strong": 0.4375, "safe": 0.5, "peace": 0.25, "celebrate": 0.5,
    "celebration": 0.5, "historic": 0.25, "record": 0.125, "beautiful": 0.875,
    "love": 0.5, "hope": 0.125, "benefit": 0.25, "boost": 0.25, "gain": 0.25,
    "gains": 0.25, "rally": 0.125, "award": 0.25, "praise": 0.5, "welcome": 0.8125,
    "bad": -0.6875, "worse": -0.4375, "worst": -1.0, "terrible": -1.0, "poor": -0.375,
    "crisis": -0.5, "attack": -0.5, "attacks": -0.5, "killed": -0.75, "kill": -0.75,
    "death": -0.5, "dead": -0.25, "violence": -0.625, "fraud": -0.5, "scam": -0.5,
    "loss": -0.25, "losses": -0.25, "fall": -0.125, "decline": -0.25, "fear": -0.5,
    "angry": -0.5, "sad": -0.5, "arrested": -0.25, "accused": -0.25, "protest": -0.25,
    "corruption": -0.5, "disaster": -0.75, "fail": -0.5, "failed": -0.5,
    "failure": -0.3125, "war": -0.5, "threat": -0.25, "danger": -0.375,
    "dangerous": -0.625, "weak": -0.375, "negative": -0.3125, "problem": -0.25,
}
NEGATION_WORD = "not"
NEGATION_FACTOR = -0.5

# Small default lemma table (token -> lemma); a user table replaces it.
DEFAULT_LEMMAS: dict[str, str] = {
    "was": "be", "were": "be", "is": "be", "are": "be", "been": "be", "being": "be",
    "has": "have", "had": "have", "did": "do", "does": "do", "went": "go", "gone": "go",
    "said": "say", "says": "say", "made": "make", "took": "take", "taken": "take",
    "children": "child", "men": "man", "women": "woman", "people": "person",
    "mice": "mouse", "feet": "foot", "teeth": "tooth", "better": "good", "best": "good",
    "matches": "match", "players": "player", "elections": "election", "ministers": "minister",
    "markets": "market", "courts": "court", "films": "film", "arrests": "arrest",
}
