"""Text functions as Column expressions: canonical names, labels, tokens, normalised answers, spans. One function per variant: near-identical rules with different edge cases keep names of their own."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "which", "with", "what", "who", "when", "where", "why", "how", "does", "do", "did", "can", "could", "would"]
#: Fixed values.
REFUSALS = ["i don't know", "i do not know", "cannot answer", "can't answer", "unknown"]
#: The explicit form of a multiple-choice answer, a letter that stands alone, a capitalised name, a quotation, and where a sentence may end.
NAMED_LETTER = r"(?i)answer\s*[:\-]?\s*\(?([A-D])\)?"
LONE_LETTER = r"(?:^|[^\p{L}\p{N}_])([A-D])(?:[^\p{L}\p{N}_]|$)"
NAME = r"[A-Z][a-z]+(?:[A-Z][A-Za-z0-9]*)*"
QUOTATION = r'"([^"]+)"'
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[{])"
#: What is cut from the front of a short answer, and of an answer's span.
SHORT_PREFIX = r"(?i)^\s*(?:final\s+)?answer\s*:\s*"
SPAN_PREFIX = r"(?i)^(?:the answer is|final answer|answer)\s*:?\s*"
#: Wordings of rejections and their codes, in order of precedence.
REJECTIONS = [
    ("redundancy", "redundant_fact"),
    ("already exists", "redundant_fact"),
    ("self-referential", "self_referential_fact"),
    ("too generic", "generic_object"),
    ("subject, predicate, or object is empty", "empty_field"),
    ("circular containment", "circular_containment"),
    ("both alive and dead", "alive_dead_conflict"),
    ("contradiction", "functional_conflict"),
    ("conflicting", "functional_conflict"),
]
#: Wordings of doubt in the verification stage.
DOUBTS = ["uncertain", "partial", "maybe"]
#: A word in any script, or what stands between two words.
WORDS_AND_GAPS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
#: Where a word begins and ends, in any script; \b differs between engines beyond ASCII.
BEGIN, END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def canonical_predicate(p: Column, default: str | None = "RELATED_TO") -> Column:
    """Upper case, every run of other characters one underscore, none at the ends; an empty name is `default` (or stays empty)."""
    name = F.regexp_replace(F.upper(F.trim(F.coalesce(p, F.lit("")))), "[^A-Z0-9]+", "_")
    name = F.regexp_replace(name, "^_+|_+$", "")
    return name if default is None else F.when(name == "", default).otherwise(name)


def confidence_label(v: Column) -> Column:
    """rejected before supported before uncertain; anything else is uncertain."""
    t = F.lower(F.trim(F.coalesce(v.cast("string"), F.lit(""))))
    return F.when(t.contains("not") | t.contains("reject") | (t == "false"), "rejected").when(t.contains("support"), "supported").otherwise("uncertain")


def confidence_label_support_first(v: Column) -> Column:
    """The variant that looks for support first, if nothing negates it."""
    t = F.lower(F.trim(F.coalesce(v.cast("string"), F.lit(""))))
    return F.when(t.contains("support") & ~t.contains("not"), "supported").when(t.contains("reject") | t.contains("false") | t.contains("not"), "rejected").otherwise("uncertain")


def ascii_tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def unicode_tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def content_tokens(t: Column) -> Column:
    """Distinct ASCII tokens without stop words and single characters."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_distinct(F.filter(ascii_tokens(t), lambda x: (F.length(x) > 1) & ~F.array_contains(stop, x)))


def word_tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(r"[\p{L}\p{N}_'-]+"), F.lit(0))


def lower_each(t: Column) -> Column:
    """Lower case character by character: a dotted capital I is one letter, a sigma the same at the end of a word."""
    return F.lower(F.translate(t, "\u0130\u03a3", "i\u03c3"))


def squeeze(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def answer_squad(t: Column) -> Column:
    """Lower case, punctuation deleted, articles out, spaces squeezed."""
    x = F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), r"[!-/:-@\[-`{-~]", "")
    return squeeze(F.regexp_replace(x, r"\b(a|an|the)\b", " "))


def answer_ascii(t: Column) -> Column:
    """answer_squad as RE2 and simple case mappings have it: words of ASCII, white space without the vertical tab, one character for each; null stays null."""
    x = F.regexp_replace(lower_each(t), r"[!-/:-@\[-`{-~]", "")
    x = F.regexp_replace(x, "(?<![0-9A-Za-z_])(a|an|the)(?![0-9A-Za-z_])", " ")
    return F.trim(F.regexp_replace(x, r"[\t\n\f\r ]+", " "))


def answer_spaced(t: Column) -> Column:
    """Punctuation to spaces, articles out, spaces squeezed."""
    x = F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), r"[!-/:-@\[-`{-~]", " ")
    return squeeze(F.regexp_replace(x, f"{BEGIN}(a|an|the){END}", " "))


def answer_plain(t: Column) -> Column:
    """Spaces squeezed, then all but letters, digits, underscores and spaces deleted; articles stay."""
    return F.regexp_replace(squeeze(F.lower(F.coalesce(t, F.lit("")))), r"[^\p{L}\p{N}_\s]", "")


def common_tokens(a: Column, b: Column) -> Column:
    """How many tokens two arrays share, repeats counted."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))


def token_f1(pred: Column, gold: Column, normalise=answer_squad) -> Column:
    """Token F1 of two texts after normalising; 1 or 0 if either is empty."""
    split = lambda t: F.filter(F.split(normalise(t), " "), lambda x: x != "")
    p, g = split(pred), split(gold)
    both = common_tokens(p, g).cast("double")
    empty = (F.size(p) == 0) | (F.size(g) == 0)
    return F.when(empty, (F.size(p) == F.size(g)).cast("double")).when(both == 0, 0.0).otherwise(2 * both / (F.size(p) + F.size(g)))


def exact_match(pred: Column, gold: Column, normalise=answer_squad) -> Column:
    return (normalise(pred) == normalise(gold)).cast("double")


def without_thoughts(t: Column) -> Column:
    """The text without its <think> blocks; the text itself if nothing else is there."""
    cut = F.trim(F.regexp_replace(t, r"(?is)<think>.*?</think>", ""))
    return F.when(cut == "", t).otherwise(cut)


def first_given(*values: Column) -> Column:
    """The first value that is neither null nor empty, else an empty text."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


def choice_letter(t: Column) -> Column:
    """The multiple-choice letter: after `answer`, else, thoughts left out, the last that stands alone, else the last at all, else empty."""
    whole = F.coalesce(t, F.lit(""))
    rest = without_thoughts(whole)
    alone = F.try_element_at(F.regexp_extract_all(rest, F.lit(LONE_LETTER), F.lit(1)), F.lit(-1))
    letters = F.regexp_replace(F.upper(rest), "[^A-D]+", "")
    return first_given(F.upper(F.regexp_extract(whole, NAMED_LETTER, 1)), alone, F.right(letters, F.lit(1)))


def seed_phrases(t: Column, most: int = 10) -> Column:
    """Capitalised phrases, then quoted strings, of more than two characters, distinct.

    The text is cut into words and gaps; everything but names and white space becomes a separator, so that what is left between two separators is a phrase.
    """
    whole, cut = F.coalesce(t, F.lit("")), "\u0001"
    parts = F.transform(F.regexp_extract_all(whole, F.lit(WORDS_AND_GAPS), F.lit(0)), lambda x: F.when(x.rlike(rf"\A(?:{NAME}|\s+)\z"), x).otherwise(cut))
    phrases = F.split(F.array_join(parts, ""), cut)
    found = F.transform(F.concat(phrases, F.regexp_extract_all(whole, F.lit(QUOTATION), F.lit(1))), lambda x: F.regexp_replace(x, r"\A\s+|\s+\z", ""))
    return F.slice(F.array_distinct(F.filter(found, lambda x: F.length(x) > 2)), 1, most)


def pieces(t: Column, most: int) -> Column:
    """A text in pieces of `most` characters, trimmed."""
    last = F.floor((F.length(t) - 1) / most).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.trim(F.substring(t, i * most + 1, F.lit(most))))


def sentences(t: Column, most: int = 1200) -> Column:
    """Sentences of the squeezed text: cut after . ! ? before a capital, digit, quote or bracket; longer ones are cut every `most` characters."""
    found = F.filter(F.split(squeeze(F.coalesce(t, F.lit(""))), SENTENCE_GAP), lambda x: x != "")
    return F.flatten(F.transform(found, lambda x: pieces(x, most)))


def rejection_code(reason: Column, stage: Column | None = None) -> Column:
    """The code of a rejection: that of the first wording of REJECTIONS that it contains; verification has codes of its own."""
    said = F.lower(F.trim(F.coalesce(reason, F.lit(""))))
    table = F.array(*(F.struct(F.lit(wording).alias("wording"), F.lit(code).alias("code")) for wording, code in REJECTIONS))
    by_rules = F.coalesce(F.get(F.filter(table, lambda r: F.contains(said, r["wording"])), F.lit(0))["code"], F.lit("validator_reject"))
    if stage is None:
        return by_rules
    doubtful = F.exists(F.array(*map(F.lit, DOUBTS)), lambda d: F.contains(said, d))
    by_model = F.concat(F.lit("llm_verification_"), F.when(doubtful, "uncertain").otherwise("rejected"))
    return F.when(F.lower(F.trim(F.coalesce(stage, F.lit("")))) == "llm_verification", by_model).otherwise(by_rules)


def answer_state(t: Column, gold: Column) -> Column:
    """answered, refusal or invalid: empty or over 12 words is invalid, unless it is the gold answer."""
    x = F.regexp_replace(F.coalesce(t, F.lit("")), r"^\s+|\s+$", "")
    bare = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    refused = F.greatest(*(F.contains(F.lower(x), F.lit(m)) for m in REFUSALS))
    return F.when(x == "", "invalid").when(bare(x) == bare(gold), "answered").when(refused, "refusal").when(F.size(F.split(x, r"\s+")) > 12, "invalid").otherwise("answered")


def lines_with_text(t: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(t, F.lit("")), r"\R"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def short_answer(t: Column) -> Column:
    """The first line with text, without a leading `answer:` or `final answer:`."""
    return F.trim(F.regexp_replace(F.coalesce(F.get(lines_with_text(t), F.lit(0)), F.lit("")), SHORT_PREFIX, ""))


def answer_span(t: Column) -> Column:
    """The last line with text, thoughts left out, without `the answer is` or the like in front, and without quotes around it."""
    spoken = F.regexp_replace(F.coalesce(t, F.lit("")), r"(?is)<think>.*?</think>", "")
    line = F.coalesce(F.try_element_at(lines_with_text(spoken), F.lit(-1)), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(line, SPAN_PREFIX, ""), r"\A\s+|\s+\z", "")
    return F.regexp_replace(F.regexp_replace(bare, r'\A"+|"+\z', ""), r"\A\s+|\s+\z", "")


def directory_name(t: Column) -> Column:
    return F.regexp_replace(F.coalesce(t, F.lit("")), "[^A-Za-z0-9._-]+", "_")


def json_object(t: Column) -> Column:
    """The outermost {...} of a text, fences and prose around it left out; null where there is none."""
    return F.nullif(F.regexp_extract(F.coalesce(t, F.lit("")), r"(?s)(\{.*\})", 1), F.lit(""))


def upper_each(t: str) -> str:
    """Of a Python text: upper case character by character, where str.upper may make several of one."""
    return "".join(next((x for x in (c.upper(), c.title(), "\u1e9e" if c == "\u00df" else c) if len(x) == 1), c) for c in t)
