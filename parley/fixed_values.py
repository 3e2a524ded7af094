"""Fixed values.

Word lists, labels, messages and limits that results must reproduce exactly.
They are data, not logic, and are kept together here in their natural order.
"""

# Code points treated as whitespace when splitting and stripping text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The same set as a Java regular-expression class.  The Latin-1 members are spelled
# one by one and the rest sits behind a range test: that form is twice as fast.
WHITESPACE_CLASS = (
    r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
)

# A text ending in one of these words counts as cut off.
DANGLING_WORDS = [
    "a", "an", "the", "to", "of", "in", "on", "at",
    "is", "are", "was", "were", "be", "been",
    "and", "or", "but", "with", "for", "from",
    "that", "this", "which", "who", "what", "when", "where",
    "have", "has", "had", "will", "would", "should",
    "can", "could", "may", "might", "must",
    "over", "under", "above", "below", "into", "onto",
    "by", "about", "as", "like", "through", "during",
]

# Characters that close a sentence.
CLOSING_MARKS = ".!?;:,'\")]}"

# Outputs that are nothing but an URL scheme.
BARE_SCHEMES = ["http://", "https://"]

# Per-rule issue text, in report order.
ISSUE_TEXT = {
    "empty": "Output is empty",
    "repetitive": "Output is highly repetitive",
    "short": "Output is too short",
    "gibberish": "Output appears to be gibberish",
    "incomplete": "Output is incomplete (cut off mid-sentence)",
    "echo": "Output echoes the input",
}

# Keys of the issue summary, in report order.
SUMMARY_KEYS = {
    "empty": "empty_outputs",
    "repetitive": "repetitive_outputs",
    "short": "short_outputs",
    "gibberish": "gibberish_outputs",
    "echo": "echo_outputs",
    "incomplete": "incomplete_outputs",
}

# Quality thresholds.
REPETITION_THRESHOLD = 0.3
MIN_WORDS = 3
MIN_LETTER_SHARE = 0.3
ECHO_OVERLAP = 0.6
GOOD_SCORE = 0.7
ACCEPTABLE_SCORE = 0.5
EXAMPLE_COUNT = 5
EXAMPLE_CHARS = 100

# Recommendation lines.
ADVICE_NO_DATA = "No conversations to analyze"
ADVICE_CRITICAL = [
    "⚠️  CRITICAL: Less than 50% of conversations are high quality",
    "Training on this data will likely produce a poorly performing model",
    "Consider filtering or regenerating your training data",
]
ADVICE_WARNING = [
    "⚠️  WARNING: Less than 70% of conversations are high quality",
    "Consider reviewing and filtering problematic conversations",
]
ADVICE_OK = "✓ Dataset quality is acceptable"
ADVICE_REPETITIVE = "High repetition detected in %d conversations"
ADVICE_EMPTY = "%d conversations have empty outputs"
ADVICE_GIBBERISH = "%d conversations contain gibberish"
ADVICE_ECHO = "%d conversations echo the input"
ADVICE_INCOMPLETE = "%d conversations have incomplete outputs"

# Prompt templates for text turned into pairs.
PROMPT_TEMPLATES = [
    "Tell me about {topic}",
    "What is {topic}?",
    "Explain {topic}",
    "Can you describe {topic}?",
    "What can you tell me about {topic}?",
    "I'd like to know about {topic}",
    "Please explain {topic}",
    "Give me information about {topic}",
    "What do you know about {topic}?",
    "Provide details on {topic}",
    "Help me understand {topic}",
    "Tell me more about {topic}",
    "What should I know about {topic}?",
    "Describe {topic} for me",
    "I'm interested in {topic}",
]
FALLBACK_TEMPLATE = "Tell me about {topic}"
NO_TOPIC = "this topic"
NO_SOURCE = "unknown source"
URL_WORDS = ["http", "https", "www"]
MIN_DOCUMENT_CHARS = 50

# Content-type label by word count (exclusive upper bound), last one open-ended.
CONTENT_TYPES = [
    (200, "brief explanation"),
    (500, "article"),
    (1000, "detailed guide"),
    (None, "comprehensive resource"),
]

# Category by keyword, first hit wins.
CATEGORIES = [
    ("tutorial", ["tutorial", "how to", "step", "guide"]),
    ("documentation", ["documentation", "reference", "api"]),
    ("concept", ["concept", "theory", "principle", "introduction"]),
    ("example", ["example", "sample", "demo"]),
]
NO_CATEGORY = "general information"

# Forecast requests.
TARGETS = ["temp", "barometer", "light", "humidity"]
FORMATS = ["json", "csv", "table"]
TARGET_KEYWORDS = {
    "temp": ["temp", "temperature"],
    "barometer": ["barometer", "pressure", "baro"],
    "humidity": ["humidity", "humid"],
    "light": ["light", "solar", "radiation"],
}
DURATION_PATTERN = r"(\d+(?:\.\d+)?)\s*[-\s]?(days?|hours?|hrs?|min(?:utes?|s)?)\b"
DEFAULT_QUERY = "sensor_id=1"
DEFAULT_DURATION = 24.0
DEFAULT_INTERVAL = 1.0
DEFAULT_FORMAT = "table"

# Chat limits and words.
MAX_PROMPT_CHARS = 4096
QUIT_WORDS = ["quit", "exit", "q"]
MAX_TOKENS = 512
FEEDBACK_THRESHOLD = 50
POLL_SECONDS = 30
MAX_FAILURES = 5
LOG_FLUSH_ROWS = 10
MAX_FILE_BYTES = 100 * 1024 * 1024

# Built-in sample pairs.
SAMPLE_PAIRS = [
    ("What is Python?", "Python is a high-level programming language."),
    ("How do I install Python?", "You can download Python from python.org."),
    ("What is machine learning?", "Machine learning is a subset of AI."),
]
