"""Fixed values that results depend on: word lists and patterns.

Written for engines with ASCII classes (Java, RE2): \\p{L} and \\p{N} stand where Unicode letters and digits count."""

# Words that say nothing about a goal's topic.
STOP_WORDS = (
    "the a an of for to in on at by and or with is are was were be been how what which who whom whose why when where best most top vs list lists give me "
    "find about into over your you i we they it that this com www http https org net html"
).split()

# Page furniture that is never an item of a list: texts anywhere in it, in lower case, ...
JUNK_TEXTS = [
    "tagged with", "table of contents", "frequently asked", "add a header", "read more", "related posts", "related articles", "related reading", "you might also",
    "more posts", "more articles", "leave a comment", "leave a reply", "share this", "share on", "subscribe", "newsletter", "sign in", "sign up", "log in", "login",
    "cookie", "privacy policy", "terms of", "©", "all rights reserved", "recent posts", "popular posts", "about the author", "about us", "contact us", "follow us",
    "»", "|", "latecomer", "walknotes", "human alternative", "frequency of use",
]
# ... and whole items, addresses, items without a letter or digit, and questions.
JUNK_WHOLE = (
    r"^((faqs?|comments?|categor(y|ies)|tags?|menu|search|home|ai (word|phrase|term)s?|word ?/? ?phrase|(before|after|example|category|alternative)s?)$|https?://|[^\p{L}\p{N}_]*$)"
)
JUNK_END = r"\?[ \t\r\n\f\v]*$"
#: The same as one pattern.
JUNK = "(?i)(" + "|".join([t.replace("|", r"\|") for t in JUNK_TEXTS] + [JUNK_WHOLE, JUNK_END]) + ")"

# Headings of reference pages that are never an entity.
META = (
    r"(?i)^(references?|notes?|see also|external links?|further reading|bibliography|citations?|sources?|contents?|categor(y|ies)|hidden categ|navigation|"
    r"articles? (with|containing|needing|using|lacking)|short description|webarchive|cs1|wikidata|isbn|doi|retrieved|archived|edit|view source|talk|"
    r"disambiguation|stub|portal|glossary|index|main page|full list|list of)\b"
)

# Goals that ask for a list, and goals that ask for everything.
ENUMERABLE = r"(?i)\b(list|lists|words|phrases|terms|examples|names|vocabulary|banned|overused|clich|enumerate|every|all|complete|comprehensive|exhaustive)\b"
EXHAUSTIVE = r"(?i)\b(every|all|complete|comprehensive|exhaustive|master list|as many)\b"
NOT_CENSUS = (
    r"(?i)^\s*(where|who|when|which|how|why|is|are|can|could|do|does|did|should|would|will|what)\b|"
    r"\b(in stock|for sale|to buy|buy|purchase|price|prices|cost|costs|near me|right now|cheapest|coupon|discount|deal|available|availability|vs\.?|versus|review|best)\b"
)

# What stands around the entity in a goal.
LEAD = (
    r"(?i)^\s*(please\s+)?(give me\s+|make\s+|build\s+|find\s+|compile\s+)?(a\s+|an\s+|the\s+)?(complete\s+|comprehensive\s+|exhaustive\s+|full\s+|master\s+)?"
    r"(list|catalog|catalogue|census|index|collection|database)\b\s*(of\s+)?"
)
QUANTIFIER = r"(?i)^\s*(every|all|each|any)\s+"
TRAIL = r"(?i)\b((ever\s+)?(mentioned|named|listed|found|referenced|documented|recorded)|on the (net|web|internet)|online|in existence|that exists?|anywhere)\b.*$"

# Titles of pages that are lists.
LIST_TITLE = r"(?i)\b[0-9]+\+?\b.{0,30}\b(words|phrases|terms|list|examples|tips|ways)\b"
LIST_HINT = r"(?i)\b(list|words|phrases|terms|avoid|overused|common|examples|banned|glossary)\b"

# Links that are never followed.
SHARE = (
    r"(?i)(twitter\.com|//x\.com|facebook\.com|linkedin\.com/(sharing|share)|/sharer|/sharearticle|/intent/|pinterest\.|reddit\.com/submit|"
    r"t\.me/share|wa\.me|api\.whatsapp|mailto:|tel:|/rss|/feed/?$)"
)
BAD_FILE = r"(?i)\.(mp4|mov|avi|webm|mp3|wav|zip|gz|tar|rar|7z|pdf|docx?|xlsx?|pptx?|jpe?g|png|gif|webp|svg|ico|css|js|json|xml|woff2?|ttf|eot)(\?|#|$)"

# Words that lean on a claim's context.
PRONOUN = r"(?i)^(he|his|him|she|her|they|their|them|it|its|this|that|these|those|we|our|i|you|there)\b"

# Facets that widen a seed without a model; the first is the seed alone.
FACETS = [
    "", "overview", "explained", "history", "how it works", "examples", "statistics data", "latest developments",
    "criticism problems", "comparison alternatives", "best practices", "case study", "vs", "guide", "research paper", "tutorial",
]

# Elements whose content is not read, and those whose text is an item.
CLOSED_BLOCKS = ["script", "style", "noscript", "svg", "head", "nav", "footer", "header", "aside", "form", "button"]
SCRIPT_BLOCKS = CLOSED_BLOCKS[:5]
ITEM_TAGS = ["li", "td", "th", "dt", "h2", "h3", "h4", "code"]
