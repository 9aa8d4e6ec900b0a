"""Fixed values the engine's results depend on (lists, patterns, limits)."""

from __future__ import annotations

# --- fixed values: MIME classes (the lists overlap on purpose) -------------
MIME_XML = ["text/xml", "application/xml", "application/rss+xml", "application/rdf+xml",
            "application/atom+xml", "application/xhtml+xml"]
MIME_RSS = ["application/rss+xml", "application/rdf+xml", "application/atom+xml"]
MIME_HTML = ["text/html", "application/xhtml+xml", "application/xml"]
MIME_JSON = ["application/json"]
MIME_CLASSES = {"xml": MIME_XML, "rss": MIME_RSS, "html": MIME_HTML, "json": MIME_JSON}

# --- fixed values: limits ----------------------------------------------------
BODY_CAP = 500 * 1024          # bytes kept of a response body
TAG_SCAN_CHARS = 10000         # characters read when looking for <meta>/<link>
MAX_ITEM = 5                   # items per feed filled with a fetch
LIM_ITEM = 10                  # items kept per feed
FEED_FORCE_MIN = 5 * 60        # seconds a stored feed is always good for
FEED_FORCE_MAX = 60 * 60       # seconds after which a stored feed is never good
ARTICLE_FORCE_MIN = 24 * 60 * 60
PERMANENT_SECONDS = 7 * 24 * 3600
STORE_SIZE = 1000
MAX_HOPS = 10

# --- fixed values: article scoring ---------------------------------------------
CLASS_BAD = ["comment", "community", "extra", "foot",
    "sponsor", "pagination", "pager", "tweet", "twitter", "com-", "masthead",
    "media", "meta", "related", "shopping", "tags", "tool", "author", "about",
    "head", "robots-nocontent", "combx", "disqus", "menu", "remark", "rss",
    "shoutbox", "sidebar", "ad-", "agegate", "popup", "sharing", "share",
    "social", "contact", "footnote", "outbrain", "promo", "scroll", "hidden",
    "widget", "hide"]

CLASS_GOOD = ["and", "article", "body", "column", "main",
    "shadow", "content", "entry", "hentry", "main", "page", "pagination",
    "post", "text", "blog", "story", "par", "editorial"]

TAGS_DANGEROUS = ["script", "head", "iframe", "object", "style", "link", "meta"]

TAGS_JUNK = TAGS_DANGEROUS + ["noscript", "param", "embed", "layer", "applet",
    "form", "input", "textarea", "button", "footer"]

TAGS_BAD = TAGS_JUNK + ["a", "aside"]

TAGS_GOOD = ["h1", "h2", "h3", "article", "p", "cite", "section", "figcaption",
    "figure", "em", "strong", "pre", "br", "hr", "headline"]

TAGS_MEANING = ["a", "abbr", "address", "acronym", "audio", "article", "aside",
    "b", "bdi", "bdo", "big", "blockquote", "br", "caption", "cite", "center",
    "code", "col", "colgroup", "data", "dd", "del", "details", "description",
    "dfn", "dl", "font", "dt", "em", "figure", "figcaption", "h1", "h2", "h3",
    "h4", "h5", "h6", "hr", "i", "img", "ins", "kbd", "li", "main", "mark",
    "nav", "ol", "p", "pre", "q", "ruby", "rp", "rt", "s", "samp", "small",
    "source", "strike", "strong", "sub", "summary", "sup", "table", "tbody",
    "td", "tfoot", "th", "thead", "time", "tr", "track", "tt", "u", "ul", "var",
    "wbr", "video"]

TAGS_KEPT_EMPTY = ["img", "hr", "br"]
ATTRIBUTES_FINE = ["title", "src", "href", "type", "value"]

# --- fixed values: links wrapped by tracking services (regex, query key) -----------
TRACKERS = [
    (r"(?s)^http://translate\.google\..*/translate.*u=.*$", "u"),
    (r"(?s)^http://www\.google\..*/url.q=.*$", "q"),
    (r"(?s)^http://news\.google\.com/news/url.*url=.*$", "url"),
    (r"(?s)^https://getpocket\.com/redirect.url=.*$", "url"),
    (r"(?s)^https://www\.facebook\.com/l\.php.u=.*$", "u"),
]

# --- fixed values: letters of the feedsportal link code ---------------------------
PORTAL_LETTERS = {"A": "0", "B": ".", "C": "/", "D": "?", "E": "-", "F": "=",
    "G": "&", "H": ",", "I": "_", "J": "%", "K": "+", "L": "http://",
    "M": "https://", "N": ".com", "O": ".co.uk", "P": ";", "Q": "|",
    "R": ":", "S": "www.", "T": "#", "U": "$", "V": "~", "W": "!",
    "X": "(", "Y": ")", "Z": "Z"}

# --- fixed values: XML namespaces ---------------------------------------------------
NS_ATOM = "http://www.w3.org/2005/Atom"
NS_ATOM03 = "http://purl.org/atom/ns#"
NS_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
NS_CONTENT = "http://purl.org/rss/1.0/modules/content/"
NS_RSS1 = "http://purl.org/rss/1.0/"
NS_FEEDBURNER = "http://rssnamespace.org/feedburner/ext/1.0"

# --- canonical schemas ----------------------------------------------------------------
FEED_COLUMNS = ["title", "desc"]
ITEM_COLUMNS = ["title", "link", "desc", "content", "time", "updated"]

RESPONSES_SCHEMA = ("url string, final_url string, code int, msg string, "
                    "headers map<string,string>, body binary, fetched_at timestamp")
