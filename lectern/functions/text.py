"""Column functions on text: hygiene, questions, code, headings, contents lines.

Patterns are written so that Java's engine gives what the semantics ask for: Unicode words by
\\p classes, multiline anchors with (?md) so that only a line feed ends a line."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, patterns and symbols that results depend on.
INTENTS = [
    ("code_request", ["implement", "code", "write", "build", "create"]),
    ("comparison", ["difference", "compare", "vs", "versus"]),
    ("debugging", ["error", "bug", "fix", "wrong", "not working"]),
    ("tutorial", ["tutorial", "walk through", "step by step", "guide"]),
]
DEFAULT_INTENT = "conceptual"
TOPICS = [
    "neural network", "cnn", "rnn", "lstm", "transformer", "gradient descent", "backpropagation", "linear regression", "logistic regression", "decision tree",
    "random forest", "svm", "clustering", "pca", "autoencoder", "gan", "reinforcement learning", "keras", "tensorflow", "sklearn",
]
STOPWORDS = ["the", "a", "an", "is", "are", "what", "how", "why", "can", "do", "me", "i", "to"]
COMPLEXITIES = [("beginner", ["basic", "simple", "beginner", "intro"]), ("advanced", ["advanced", "complex", "deep dive", "detailed"])]
CODE_CUES = ["code", "implement", "write", "show me", "example"]
SYMBOLS = "{}[]();=<>:+-*/\\"
CODE_BROAD = [r"^\s{4,}\w+", r"^\s*def\s+\w+\(", r"^\s*class\s+\w+", r"```", r";\s*$", r"\bimport\s+\w+", r"\bfrom\s+\w+\s+import\b"]
CODE_STRICT = [r"^\s{4,}\w+", r"^\s*def\s+\w+\(", r"^\s*class\s+\w+", r"```", r"\bimport\s+\w+", r"\bfrom\s+\w+\s+import\b", r"public\s+(class|static|void)", r"function\s+\w+\s*\("]
CHAPTER_WORD = r"(?i)^(?:chapter|ch)\s+(\d+)\b[:\s-]*(.*)$"
LEADING_NUMBER = r"(?i)^(\d+(?:\.\d+)*)\s*[:\-–—]?\s*(.+)$"
CHAPTER_PATTERNS = [
    r"(?i)^(?:chapter|ch\.?)\s+(\d+)\b[:\s-]*(.*)$",
    r"^(\d+)[:\.\s-]+(.+)$",
    r"(?i)^(appendix|epilogue|introduction|preface|foreword)\b[:\s-]*(.*)$",
]
#: Pattern and its groups for number, title and page.
CONTENTS_PATTERNS = [
    (r"(?i)^(chapter|ch\.?)\s+(\d+)[:\s-]*(.*?)\s*\.{2,}\s*(\d+)\s*$", 2, 3, 4),
    (r"^(\d+(\.\d+)*)\s+(.*?)\s*\.{2,}\s*(\d+)\s*$", 1, 3, 4),
    (r"^([A-Z].*?)\s*\.{2,}\s*(\d+)\s*$", 0, 1, 2),
    (r"^(\d+(\.\d+)*)\s+(.+?)\s{3,}(\d+)\s*$", 1, 3, 4),
    (r"^([A-Z][^.]{3,}?)\s{3,}(\d+)\s*$", 0, 1, 2),
]
CONTENTS_KEYWORDS = ["table of contents", "contents", "table des matières", "índice"]
MONOSPACE = ["courier", "mono", "consolas", "menlo", "monaco", "monospace"]
BASE_PROMPT = "You are an expert ML/AI assistant with access to technical books.\nUse the provided sources to give accurate, well-cited answers.\nAlways reference sources by number [SOURCE 1], [SOURCE 2], etc."
INTENT_PROMPTS = {
    "code_request": "\n\nProvide working code with explanations.",
    "conceptual": "\n\nExplain clearly with examples.",
    "comparison": "\n\nCompare and contrast systematically.",
    "debugging": "\n\nIdentify issues and provide fixes.",
    "tutorial": "\n\nProvide step-by-step guidance.",
}
COMPLEXITY_PROMPTS = {"beginner": " Use simple language.", "intermediate": " Balance theory and practice.", "advanced": " Include technical details."}


def either(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def has_any(text: Column, parts: list[str]) -> Column:
    """Whether text contains one of the parts as a substring."""
    return either([F.contains(text, F.lit(p)) for p in parts])


def strip(text: Column) -> Column:
    """Without white space (of ASCII) at both ends. No pattern: that would look at every place of a long line."""
    return F.trim(text, F.lit(" \t\n\x0b\f\r"))


# --- questions ---------------------------------------------------------------------------------


def intent(question: Column) -> Column:
    q = F.lower(question)
    first, *rest = INTENTS
    out = F.when(has_any(q, first[1]), first[0])
    for name, cues in rest:
        out = out.when(has_any(q, cues), name)
    return out.otherwise(DEFAULT_INTENT)


def topics(question: Column) -> Column:
    q = F.lower(question)
    return F.filter(F.array(*map(F.lit, TOPICS)), lambda t: F.contains(q, t))


def keywords(question: Column) -> Column:
    """Words over two letters that aren't stopwords; a repeated word stays repeated."""
    words = F.regexp_extract_all(F.lower(question), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOPWORDS) & (F.length(w) > 2))


def plain_keywords(question: Column) -> Column:
    return F.filter(F.split(strip(question), r"\s+"), lambda w: w != "")


def complexity(question: Column) -> Column:
    q = F.lower(question)
    return F.when(has_any(q, COMPLEXITIES[0][1]), COMPLEXITIES[0][0]).when(has_any(q, COMPLEXITIES[1][1]), COMPLEXITIES[1][0]).otherwise("intermediate")


def code_language(question: Column) -> Column:
    return F.when(has_any(F.lower(question), CODE_CUES), "python")


def question_error(question: Column, low: int = 3, high: int = 1000) -> Column:
    """Why a question isn't valid, or null."""
    q = strip(question)
    n = F.length(q)
    return (
        F.when(question.isNull(), "Query is None")
        .when(q == "", "Query is empty")
        .when(n < low, F.format_string(f"Query too short (min {low} characters, got %d)", n))
        .when(n > high, F.format_string(f"Query too long (max {high} characters, got %d)", n))
        .when(~q.rlike(r"[\p{L}\p{N}]"), "Query must contain at least one alphanumeric character")
    )


def error_message(error: Column, default: str) -> Column:
    return F.coalesce(error, F.lit(default))


def system_prompt(intent_: Column, complexity_: Column) -> Column:
    pick = lambda values, key: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(""))
    return F.concat(F.lit(BASE_PROMPT), pick(INTENT_PROMPTS, intent_), pick(COMPLEXITY_PROMPTS, complexity_))


# --- code --------------------------------------------------------------------------------------


def symbol_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def contains_code(text: Column, rule: str = "broad") -> Column:
    """Whether a text holds code: one of the rule's patterns, or many symbols."""
    patterns, least, longer = (CODE_BROAD, 0.01, 0) if rule == "broad" else (CODE_STRICT, 0.03, 50)
    n = F.length(text)
    dense = (n > longer) & (symbol_count(text) / F.greatest(n, F.lit(1)) > least)
    return text.rlike("(?md)" + "|".join(f"(?:{p})" for p in patterns)) | dense


# --- headings ----------------------------------------------------------------------------------


def is_monospace(font: Column) -> Column:
    return F.coalesce(F.lower(font).rlike("|".join(MONOSPACE)), F.lit(False))


def heading_number(text: Column) -> Column:
    """Number of a heading: after a chapter word, or leading; else null."""
    s = strip(text)
    return F.when(s.rlike(CHAPTER_WORD), F.regexp_extract(s, CHAPTER_WORD, 1)).when(s.rlike(LEADING_NUMBER), F.regexp_extract(s, LEADING_NUMBER, 1))


def heading_title(text: Column) -> Column:
    s = strip(text)
    chapter = F.regexp_extract(s, CHAPTER_WORD, 2)
    return F.when(s.rlike(CHAPTER_WORD), strip(F.when(chapter == "", s).otherwise(chapter))).when(s.rlike(LEADING_NUMBER), strip(F.regexp_extract(s, LEADING_NUMBER, 2))).otherwise(s)


def is_numeric_heading(text: Column) -> Column:
    return F.lower(text).rlike(r"^(chapter\s+\d+|\d+(\.\d+)*\b)")


def is_chapter_heading(text: Column) -> Column:
    return either([text.rlike(p) for p in CHAPTER_PATTERNS])


def chapter_number(text: Column) -> Column:
    """First group of the first chapter pattern (a number or a word), else a leading number."""
    first, *rest = CHAPTER_PATTERNS
    out = F.when(text.rlike(first), F.regexp_extract(text, first, 1))
    for p in rest:
        out = out.when(text.rlike(p), F.regexp_extract(text, p, 1))
    return out.when(text.rlike(r"^\d"), F.regexp_extract(text, r"^(\d+(\.\d+)*)", 1))


def dots(number: Column) -> Column:
    return F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))


def heading_level(text: Column, size: Column, median: Column) -> Column:
    number = chapter_number(text)
    return (
        F.when(has_any(F.lower(text), ["chapter", "appendix", "part"]), 1)
        .when(number.isNotNull() & (number != ""), F.least(dots(number) + 1, F.lit(3)))
        .when(size > median * 1.5, 1)
        .when(size > median * 1.2, 2)
        .otherwise(3)
        .cast("int")
    )


# --- contents lines ----------------------------------------------------------------------------


def ends_in_page(text: Column) -> Column:
    """What all patterns of contents ask for; most lines are ruled out by it."""
    return text.rlike(r"\d\s*$")


def is_contents_line(text: Column) -> Column:
    return ends_in_page(text) & either([text.rlike(p) for p, *_ in CONTENTS_PATTERNS])


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def contents_entry(line: Column) -> Column:
    """struct(number, title, page, level) of the first pattern that gives a title of two
    characters or more; else null."""

    def entry(e: Column) -> Column:
        n, title = e["n"], e["t"]
        level = F.when(n.isNull() | (n == ""), F.when(has_any(F.lower(title), ["chapter", "part", "appendix"]), 1).otherwise(2)).otherwise(F.least(dots(n) + 1, F.lit(3)))
        return F.when((F.length(title) >= 2) & e["p"].isNotNull(), F.struct(n.alias("number"), title.alias("title"), e["p"].alias("page"), level.cast("int").alias("level")))

    def first(s: Column) -> Column:
        found = []
        for pattern, number, title, page in CONTENTS_PATTERNS:
            group = lambda k, s=s, pattern=pattern: F.regexp_extract(s, pattern, k)
            n = strip(group(number)) if number else F.lit(None).cast("string")
            parts = F.struct(n.alias("n"), strip(group(title)).alias("t"), F.try_to_number(group(page), F.lit("9" * 18)).cast("long").alias("p"))
            found.append(F.when(s.rlike(pattern), once(parts, entry)))
        return F.when((F.length(s) >= 3) & ends_in_page(s), F.coalesce(*found))

    return once(strip(line), first)
