"""Predicates and string functions over columns of text, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def _ranges(pairs) -> str:
    return "".join(f"\\x{{{a}}}-\\x{{{b}}}" for a, b in pairs)


MARKS = f"[{_ranges(C.MARKS)}]"
RTL = f"[{_ranges(C.RTL)}]"
OCR_RTL = f"[{_ranges(C.OCR_RTL)}]"
#: What parts words: neither letter (with the marks that go with letters) nor number.
NOT_WORD = "[^\\p{IsAlphabetic}\\p{N}]"


def bare(c: Column) -> Column:
    """Without white space at its ends."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def squeezed(c: Column) -> Column:
    """With one blank for each run of white space, and none at the ends."""
    return F.trim(F.regexp_replace(c, "(?U)\\s+", " "))


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


# Lines and rows


def one_line(c: Column) -> Column:
    return ~c.contains("\n")


def starts_with_bullet(c: Column) -> Column:
    return c.rlike(f"(?U)^[{C.BULLETS}](\\s|\\z)")


def is_bare_label(c: Column) -> Column:
    return (F.length(c) <= C.BARE_MAX) & c.rlike("\\p{IsAlphabetic}") & ~c.rlike("[:：]") & ~c.rlike("[.!?؟;,،]\\z")


def label_of(c: Column) -> Column:
    return F.regexp_extract(c, "^([^:：]*)[:：]", 1)


def value_of(c: Column) -> Column:
    return bare(F.regexp_extract(c, "(?s)^[^:：]*[:：](.*)\\z", 1))


def is_label_value(c: Column) -> Column:
    return c.rlike("[:：]") & (F.length(label_of(c)) <= C.LABEL_MAX) & label_of(c).rlike("\\p{IsAlphabetic}") & (value_of(c) != "")


def is_row(c: Column) -> Column:
    return is_label_value(c) & (F.length(value_of(c)) <= C.VALUE_MAX)


def is_numbered(c: Column) -> Column:
    return c.rlike(f"(?U){C.NUMBERED}")


def without_fill_in(c: Column) -> Column:
    return F.regexp_replace(c, C.FILL_IN, " ")


def joins_label(label: Column, value: Column) -> Column:
    plain = ~is_numbered(value) & ~starts_with_bullet(value) & ~value.rlike("[.!?؟]\\z")
    return is_bare_label(label) & one_line(label) & one_line(value) & plain & (F.length(value) <= C.JOINED_MAX)


def maybe_rows(c: Column) -> Column:
    return one_line(bare(c)) & (count_of(c, ": ") >= 3)


def is_amendment(c: Column) -> Column:
    return c.rlike(f"(?iu)({C.AMENDMENT})")


def strip_markup(c: Column) -> Column:
    return F.regexp_replace(c, "\\*\\*|</?u>", "")


def scoring_text(c: Column) -> Column:
    """The text with an all-capitals label in lower case; the value stays."""
    label = label_of(c)
    capitals = is_label_value(c) & (count_of(label, "\\p{IsAlphabetic}") >= 2) & ~label.rlike("\\p{IsLowercase}")
    return F.when(capitals, F.concat(F.lower(label), F.substring(c, F.length(label) + 1, F.length(c)))).otherwise(c)


def is_rtl_letter(c: Column) -> Column:
    return c.rlike(f"^{RTL}")


def mostly_rtl(c: Column) -> Column:
    """Whether right-to-left characters are more than half of the letters, as for text read from pictures."""
    return 2 * count_of(c, OCR_RTL) > count_of(c, "\\p{IsAlphabetic}")


def is_leader(c: Column) -> Column:
    return c.rlike(f"^[{C.LEADERS}]+\\z")


def is_box_glyph(c: Column) -> Column:
    """Only box glyphs; an empty word counts as one."""
    return c.rlike(f"^[{C.BOX_GLYPHS}]*\\z")


# Words


def stem(c: Column) -> Column:
    out = F.when(F.lit(False), c)
    for s in C.SUFFIXES:
        out = out.when((F.length(c) > len(s) + 3) & c.endswith(s), F.substring(c, F.lit(1), F.length(c) - len(s)))
    return out.otherwise(c)


def search_words(c: Column) -> Column:
    """array<string> of stemmed search tokens, repeats kept."""
    low = F.lower(F.regexp_replace(c, MARKS, ""))
    words = F.filter(F.split(low, "[^\\p{IsAlphabetic}\\p{N}_]+"), lambda w: (F.length(w) > 1) & ~w.isin(*C.STOP_WORDS))
    return F.transform(words, stem)


def label_words(c: Column) -> Column:
    """Lower-case words of three characters or more with a letter that name something."""
    words = F.filter(F.split(c, NOT_WORD), lambda w: (F.length(w) >= 3) & w.rlike("\\p{IsAlphabetic}"))
    return F.filter(F.transform(words, F.lower), lambda w: ~w.isin(*C.ASKING))


def same_start(a: Column, b: Column) -> Column:
    """Whether two words agree in their first five letters, or in the length of the shorter one."""
    n = F.least(F.lit(5), F.length(a), F.length(b))
    return F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)


def word_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, NOT_WORD, ""))


def word_keys(c: Column) -> Column:
    """Letters and digits of each word, lower-case; words of neither fall away."""
    return F.filter(F.transform(F.split(c, "(?U)\\s+"), word_key), lambda w: w != "")


def count_words(c: Column, words: tuple[str, ...]) -> Column:
    return F.size(F.filter(F.split(F.lower(c), "[^\\p{IsAlphabetic}]"), lambda w: w.isin(*words)))


def language_markers(c: Column, script: Column) -> Column:
    """'de' or 'en', 'ar' or 'fa': of a script's two languages the one with more signs, the usual one on a tie."""
    german = count_words(c, C.GERMAN) + count_of(F.lower(c), "[äöüß]")
    latin = F.when(german > count_words(c, C.ENGLISH), "de").otherwise("en")
    arabic = F.when(count_of(c, "ة") > count_of(c, "[پچژگ]"), "ar").otherwise("fa")
    return F.when(script == "Arabic", arabic).when(script == "Latin", latin)


def accepted_script(script: Column, confidence: Column) -> Column:
    """The script if it is one that can be read and is sure enough."""
    return F.when((confidence > C.SCRIPT_CONFIDENCE) & script.isin(*C.SCRIPT_LANGUAGES), script)


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v))])


def script_languages(script: Column) -> Column:
    return F.element_at(_literal_map(C.SCRIPT_LANGUAGES), script)


def ocr_code(language: Column) -> Column:
    return F.element_at(_literal_map(C.OCR_CODES), language)


# Labels of fields


def clean_label(c: Column) -> Column:
    """Label without fill-in words, leading number, end marks and outer brackets; null below two letters."""
    words = F.filter(F.split(squeezed(c), " "), lambda w: ~w.rlike("^[_.…-]*\\z"))
    first = F.get(words, F.lit(0))
    number = (first.rlike("^\\(*[0-9.]*[0-9][.)]*\\z") & (F.length(first) <= 5)) | ((F.length(first) == 2) & first.endswith(")"))
    rest = F.when(number, F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))).otherwise(words)
    sideways = (F.size(rest) > 1) & F.forall(rest, lambda w: F.length(w) == 1)
    out = bare(F.regexp_replace(F.array_join(rest, " "), "[:：* ]+\\z", ""))
    out = bare(F.regexp_replace(out, "(?s)^\\((.*)\\)\\z", "$1"))
    return F.when(~sideways & (count_of(out, "\\p{IsAlphabetic}") >= 2), out)


def tooltip_label(c: Column) -> Column:
    """A tooltip that reads like a label, without the number of its row; null for generic names and long texts."""
    out = F.regexp_replace(squeezed(F.regexp_replace(c, "_", " ")), "^(.*) Row [0-9]*\\z", "$1")
    generic = F.lower(out).rlike("^(" + "|".join(C.GENERIC_TOOLTIPS) + ")[0-9 .\\[\\]]*\\z")
    return F.when(~generic & (count_of(out, "\\p{IsAlphabetic}") >= 3) & (F.length(out) <= 80), out)


def tool_label(c: Column) -> Column:
    return F.left(c, F.lit(C.TOOL_LABEL_MAX))


def place_weight(grp: Column, place: Column) -> Column:
    """How much a text counts for a field of a group by the place where it stands."""
    out = F.when(F.lit(False), F.lit(1.0))
    for group, places in C.PLACE_WEIGHTS.items():
        for at, weight in places.items():
            out = out.when((grp == group) & (place == at), F.lit(weight))
    return out.otherwise(F.lit(1.0))


def date_line(epoch: Column) -> Column:
    return F.concat(F.lit("date: "), F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd EEE HH:mm"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


# Commands


def is_signing(c: Column) -> Column:
    return c.rlike("(?iu)^\\s*(please\\s+)?(sign\\b|add\\s+(my\\s+|a\\s+)?signature\\b)")


def is_clearing(c: Column) -> Column:
    return c.rlike("(?iu)^\\s*(please\\s+)?(clear|empty|erase|delete|remove)\\b")


def is_ticking(c: Column) -> Column:
    return c.rlike("(?iu)\\b(tick|untick|check|uncheck|select|mark)\\b")


def is_unticking(c: Column) -> Column:
    return c.rlike("(?iu)\\b(untick|uncheck|unmark|deselect)\\b")


def is_value_like(c: Column) -> Column:
    return c.rlike("\\d|@|:\\s*\\S")


def says_today(c: Column) -> Column:
    """Whether a value is only a way to say today."""
    return F.lower(_trimmed(c)).isin("today", "today's date", "todays date", "the date of today")


def rules_decide(c: Column) -> Column:
    """Whether no model need be asked: a tick word for one field, or one 'label: value'."""
    colons = count_of(c, ":")
    return (is_ticking(c) & (colons == 0) & ~c.contains(",") & ~c.contains(" and ")) | (~is_ticking(c) & (colons == 1))


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{NOT_WORD}+|{NOT_WORD}+\\z", "")


def same_as(c: Column) -> Column:
    """struct<target, source> of 'X same as Y', or null."""
    part = lambda i: _trimmed(F.regexp_extract(c, "(?iu)^(.*?)\\bsame\\s+as\\b(.*)\\z", i))
    left, right = part(1), part(2)
    return F.when((left != "") & (right != ""), F.struct(left.alias("target"), right.alias("source")))


def extracted_value(command: Column, model_value: Column, held_back: Column, today: Column) -> Column:
    """The value that a command gives; text after the last colon ends the chain even if it is blank."""
    some = lambda x: F.when(bare(x) != "", bare(x))
    after = F.regexp_extract(command, "(?s)^.*:(.*)\\z", 1)
    verb = some(F.regexp_extract(command, "\\b(?:is|are|was)\\s+(.+)\\z", 1))
    digits = F.regexp_extract(command, "(\\S*\\d.*)\\z", 1)
    rest = F.coalesce(verb, some(held_back), F.when(digits != "", digits))
    value = F.coalesce(some(model_value), F.when(command.contains(":"), some(after)).otherwise(rest))
    return F.when(says_today(value), today).when(value.isNull() & command.rlike("(?i)\\btoday\\b"), today).otherwise(value)


def after_label(command: Column, label: Column) -> Column:
    """The command behind the words that name its field; null if no word of the label leads or nothing is left."""
    words, known = F.split(squeezed(command), " "), word_keys(label)
    leads = lambda k: (k != "") & (F.array_contains(known, k) | k.isin(*C.LABEL_FILLERS))
    first = F.array_position(F.transform(words, lambda w: leads(word_key(w))), False).cast("int")
    named = F.exists(F.slice(words, F.lit(1), F.greatest(first - 1, F.lit(0))), lambda w: F.array_contains(known, word_key(w)))
    return F.when((first > 1) & named, F.array_join(F.slice(words, first, F.size(words)), " "))


def command_parts(c: Column) -> Column:
    """The parts of a command at commas, semicolons, 'and' and 'plus'; null below two, and for one 'label: value'."""
    parts = F.filter(F.split(c, "(?iu)\\s*(?:[,;]\\s|\\band\\b|\\bplus\\b)\\s*"), lambda x: bare(x) != "")
    return F.when((count_of(c, ":") != 1) & (F.size(parts) >= 2), parts)
