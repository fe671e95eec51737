"""Fixed values.

Everything in this module is a constant of the playlist format or of the
cleaning rules.  The lists decide results, so they are written out plainly and
in their natural order; no logic lives here.
"""

# URL schemes a stream link may start with.
STREAM_SCHEMES = ["http", "https", "rtmp", "rtsp", "mms", "mmsh", "rtp"]

# Path endings that mark a link as not being a media stream.
NON_MEDIA_EXTENSIONS = [
    "jpg", "jpeg", "png", "gif", "bmp", "ico", "svg", "webp",
    "html", "htm", "php", "asp", "aspx", "jsp",
    "css", "js", "json", "xml",
    "txt", "pdf", "doc", "docx",
    "zip", "rar", "7z", "tar", "gz",
]

# Hosts that are never a stream.
LOCAL_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0"]
# 127.0.0.1 and 0.0.0.0 as numbers.
LOCAL_ADDRESSES = [0x7F000001, 0]

# Query parameters that do not identify a stream (prefixes).
TRACKING_PREFIXES = [
    "utm_", "session", "sid=", "token=", "t=", "ts=",
    "timestamp=", "_=", "random=", "r=", "cache=", "nocache=",
]

# Quality tags dropped from the end of a name.
QUALITY_TAGS = ["hd", "sd", "fhd", "uhd", "4k", "1080p", "720p", "480p", "360p"]

# Names too common to identify a channel.
GENERIC_NAMES = [
    "channel", "test", "live", "stream", "tv", "video", "audio", "radio",
    "news", "sports", "movie", "music", "entertainment",
]

# Attributes with a column of their own, never kept as extras.
KNOWN_ATTRIBUTES = ["tvg-id", "tvg-name", "tvg-logo", "group-title", "x-tvg-url", "url-tvg"]

# Fixed value: label of rows without a group.
UNCATEGORIZED = "Uncategorized"

# Fixed value: how many raw lines after an entry may hold its link.
LOOK_AHEAD = 4

# Category keywords; the first category with a match wins.
CATEGORY_KEYWORDS = {
    "News": [
        "news", "cnn", "bbc", "fox news", "msnbc", "cnbc", "sky news", "al jazeera", "euronews",
        "france 24", "dw", "rt", "noticias", "nachrichten", "actualités", "akhbar", "haberleri",
        "wiadomości", "nyheter", "uutiset",
    ],
    "Sports": [
        "sport", "espn", "fox sports", "sky sports", "bein", "dazn", "eurosport", "nba", "nfl",
        "mlb", "nhl", "football", "soccer", "tennis", "golf", "racing", "f1", "moto gp", "ufc",
        "wwe", "boxing", "cricket", "rugby",
    ],
    "Movies": [
        "movie", "cinema", "film", "hbo", "cinemax", "starz", "showtime", "tcm", "amc",
        "hallmark", "lifetime", "fx", "tnt", "tbs", "filmy", "kino", "pelicula", "cine",
    ],
    "Series": [
        "series", "netflix", "amazon", "hulu", "apple tv", "paramount+", "peacock",
        "discovery+", "drama", "comedy central", "syfy", "usa network",
    ],
    "Documentary": [
        "documentary", "docu", "discovery", "national geographic", "nat geo", "history",
        "animal planet", "smithsonian", "pbs", "arte", "bbc four", "curiosity",
    ],
    "Kids": [
        "kids", "children", "cartoon", "nick", "nickelodeon", "disney", "baby", "junior",
        "toon", "boomerang", "pbs kids", "cbbc", "cbeebies", "jim jam", "duck tv", "baby tv",
    ],
    "Music": [
        "music", "mtv", "vh1", "vevo", "trace", "cmtv", "club", "hits", "radio", "concert",
        "musica", "musik", "musique",
    ],
    "Entertainment": [
        "entertainment", "e!", "bravo", "tlc", "reality", "talk show", "variety", "game show",
        "comedy", "late night",
    ],
    "Lifestyle": [
        "lifestyle", "food", "cooking", "travel", "hgtv", "diy", "home", "garden", "fashion",
        "health", "wellness",
    ],
    "Religious": [
        "religious", "god", "church", "christian", "catholic", "gospel", "faith", "prayer",
        "bible", "jesus", "islamic", "quran", "jewish", "hindu", "buddhist", "ewtn", "tbn",
        "daystar",
    ],
    "Education": [
        "education", "learning", "science", "school", "university", "lecture", "ted",
        "khan academy", "coursera",
    ],
    "Adult": [
        "adult", "xxx", "18+", "playboy", "hustler", "penthouse", "erotic", "hot",
    ],
}

# Language marks as (mark, code, language, country).  Marks of two
# letters count only as a prefix or in brackets, longer ones anywhere in the text.
LANGUAGES = [
    ("US", "en", "English", "USA"),
    ("USA", "en", "English", "USA"),
    ("UK", "en", "English", "UK"),
    ("GB", "en", "English", "UK"),
    ("CA", "en", "English", "Canada"),
    ("AU", "en", "English", "Australia"),
    ("DE", "de", "German", "Germany"),
    ("AT", "de", "German", "Austria"),
    ("FR", "fr", "French", "France"),
    ("ES", "es", "Spanish", "Spain"),
    ("MX", "es", "Spanish", "Mexico"),
    ("IT", "it", "Italian", "Italy"),
    ("PT", "pt", "Portuguese", "Portugal"),
    ("BR", "pt", "Portuguese", "Brazil"),
    ("NL", "nl", "Dutch", "Netherlands"),
    ("PL", "pl", "Polish", "Poland"),
    ("RU", "ru", "Russian", "Russia"),
    ("TR", "tr", "Turkish", "Turkey"),
    ("AR", "ar", "Arabic", "Arab"),
    ("IN", "hi", "Hindi", "India"),
    ("JP", "ja", "Japanese", "Japan"),
    ("KR", "ko", "Korean", "South Korea"),
    ("CN", "zh", "Chinese", "China"),
    ("RO", "ro", "Romanian", "Romania"),
    ("GR", "el", "Greek", "Greece"),
    ("SE", "sv", "Swedish", "Sweden"),
    ("NO", "no", "Norwegian", "Norway"),
    ("DK", "da", "Danish", "Denmark"),
    ("FI", "fi", "Finnish", "Finland"),
    ("ENGLISH", "en", "English", None),
    ("GERMAN", "de", "German", None),
    ("FRENCH", "fr", "French", None),
    ("SPANISH", "es", "Spanish", None),
    ("ITALIAN", "it", "Italian", None),
    ("PORTUGUESE", "pt", "Portuguese", None),
    ("DUTCH", "nl", "Dutch", None),
    ("POLISH", "pl", "Polish", None),
    ("RUSSIAN", "ru", "Russian", None),
    ("TURKISH", "tr", "Turkish", None),
    ("ARABIC", "ar", "Arabic", None),
    ("HINDI", "hi", "Hindi", None),
    ("LATINO", "es", "Spanish", "Latin America"),
    ("PERSIAN", "fa", "Persian", None),
    ("FARSI", "fa", "Persian", None),
    ("GREEK", "el", "Greek", None),
    ("ROMANIAN", "ro", "Romanian", None),
    ("HUNGARIAN", "hu", "Hungarian", None),
    ("CZECH", "cs", "Czech", None),
    ("SLOVAK", "sk", "Slovak", None),
    ("SERBIAN", "sr", "Serbian", None),
    ("CROATIAN", "hr", "Croatian", None),
    ("BULGARIAN", "bg", "Bulgarian", None),
    ("UKRAINIAN", "uk", "Ukrainian", None),
]

# Codec prefixes in a stream manifest, by kind.
VIDEO_CODECS = [("avc1", "H.264"), ("hvc1", "HEVC"), ("hev1", "HEVC"), ("vp9", "VP9"), ("av01", "AV1")]
AUDIO_CODECS = [("mp4a", "AAC"), ("ac-3", "AC3"), ("opus", "Opus")]

# Texts that reveal an error page, at its start or anywhere in it.
ERROR_PAGE_STARTS = ["<!DOCTYPE", "<html", "404", "403", "Error"]
ERROR_PAGE_TEXTS = ["not found", "access denied"]

# Bytes looked at for the error-page test and the content signature.
PAGE_PREFIX_BYTES = 2000
SIGNATURE_MIN_BYTES = 256
SIGNATURE_HEX_CHARS = 16
CAPTURE_MAX_BYTES = 8192

# Fixed value: how often a link is tried.
MAX_ATTEMPTS = 3

# Patterns of the formats that are read.
# The fields of a stream manifest, and the start of an XHTML page.
MANIFEST_RESOLUTION = r"(?i)RESOLUTION=(\d+)x(\d+)"
MANIFEST_BANDWIDTH = r"(?i)BANDWIDTH=(\d+)"
MANIFEST_CODECS = r'(?i)CODECS="([^"]+)"'
XHTML_START = r"(?is)^<\?xml.*<html"
# A country code before or within a name.
COUNTRY_PREFIX = r"(?U)^([A-Za-z]{2})[\s:|-]+"
COUNTRY_BRACKET = r"\[[A-Za-z]{2}\]|\([A-Za-z]{2}\)"
