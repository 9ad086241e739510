"""Text clean-up as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def company_key(name: Column) -> Column:
    """A name without legal suffixes, punctuation and case."""
    upper = F.upper(F.trim(F.coalesce(name, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(upper, r"\b(S\.?P\.?A\.?|LTD|INC|CORP|CO|LIMITED)\b", ""), "[^A-Z0-9]", "")


def file_key(name: Column) -> Column:
    """A name that any file system takes."""
    return F.regexp_replace(name, r'[\\/*?:"<>| ]', "_")


def folder_key(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_\-.]", "_")


#: What layout objects, paragraphs, headings and page breaks of OCR output look like.
LAYOUT = (r'\{[^{}]*"bbox_norm"[^{}]*\}', r'"bbox_norm"\s*:\s*\[[^\]]*\]', r'"block_type"\s*:\s*"[^"]*"', r'"block_id"\s*:\s*\d+')
BREAKS = (r"</?p\s*>", r"</?div[^>]*>")
HEADING, HEADING_WITH_NOTE = r"(?<!\n)\s*(#{1,6}\s+)", r"(#{1,6}\s+[^\[\n]+\s*\[[^\]]+\])\s+(?=[A-Z0-9])"
PAGE_BREAKS = ((r"\{\d+\}-{10,}", r"\n*\{\d+\}-{10,}\n*"), ("\f", "\f"), (r"\n\s*(?:<!--\s*pagebreak\s*-->|[-*]{3,})\s*\n",) * 2)


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def ocr_markdown(text: Column) -> Column:
    """OCR output as Markdown: where it has layout objects these go and its tags become lines and headings; headings stand apart, blank lines collapse."""
    rules = [(rf"<h{n}\s*>(.*?)</h{n}>", f"\n\n{'#' * n} $1\n\n") for n in range(6, 0, -1)] + [(p, "\n") for p in BREAKS] + [(p, "") for p in LAYOUT]
    plain = reduce(lambda t, rule: F.regexp_replace(t, *rule), rules, text)
    apart = F.regexp_replace(F.regexp_replace(F.when(text.rlike("bbox_norm|block_type"), plain).otherwise(text), HEADING, "\n\n$1"), HEADING_WITH_NOTE, "$1\n\n")
    return F.when(text == "", text).otherwise(_trimmed(F.regexp_replace(apart, r"\n{3,}", "\n\n")))


def ocr_pages(text: Column) -> Column:
    """Pages of OCR output, cut at the first kind of page break that is there and leaves any text; else the whole is one page."""

    def cut(sign: str, pattern: str) -> Column:
        pages = F.filter(F.transform(F.split(text, pattern, -1), _trimmed), lambda p: p != "")
        return F.when(text.rlike(sign) & (F.size(pages) > 0), pages)

    return F.coalesce(*(cut(*b) for b in PAGE_BREAKS), F.array(_trimmed(text)))


def json_of(text: Column) -> Column:
    """The JSON in a model's answer: without thinking blocks, fences and invalid escapes."""
    s = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    s = F.when(s.rlike(r"(?s)```(?:json)?\s*.*?```"), F.regexp_extract(s, r"(?s)```(?:json)?\s*(.*?)```", 1)).otherwise(s)
    return F.trim(F.regexp_replace(s, r'\\(?!["\\/bfnrtu])', r"\\\\"))


def json_array(text: Column) -> Column:
    return F.nullif(F.regexp_extract(json_of(text), r"(?s)\[.*\]", 0), F.lit(""))


def json_object(text: Column) -> Column:
    return F.nullif(F.regexp_extract(json_of(text), r"(?s)\{.*\}", 0), F.lit(""))


#: Frequent short words of the two languages told apart.
ITALIAN = ("il", "lo", "la", "le", "gli", "di", "del", "della", "che", "per", "con", "una", "uno", "sono", "non", "dei", "delle", "nel", "alla", "euro")
ENGLISH = ("the", "of", "and", "to", "in", "is", "that", "for", "with", "was", "are", "this", "from", "by", "on", "as", "at", "be", "or", "an")


def language(text: Column) -> Column:
    """`it` or `en`, by the frequent words of the whole text; `en` where nothing tells."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    italian, english = F.size(F.filter(words, lambda w: w.isin(*ITALIAN))), F.size(F.filter(words, lambda w: w.isin(*ENGLISH)))
    return F.when(italian > english, "it").otherwise("en")


def file_language(text: Column, max_chars: int = 10_000) -> Column:
    """language() of the head of a file's text."""
    return language(F.substring(text, 1, max_chars))


def _choice(text: Column, joined: str, names: dict[str, str], default: Column | None, what: str) -> Column:
    key = F.regexp_replace(F.lower(F.trim(text)), "[ _-]" if joined == "" else "[ -]", joined)
    out = F.when(text.isNull(), default if default is not None else F.raise_error(F.lit(f"{what} is missing")).cast("string"))
    for k, v in names.items():
        out = out.when(key == k, v)
    return out.otherwise(F.raise_error(F.concat(F.lit(f"no such {what}: "), text)).cast("string"))


def form_type(text: Column) -> Column:
    return _choice(text, "", {"form11": "form11", "form12": "form12", "cg1": "cg1", "formcg1": "cg1", "undetermined": "undetermined", "none": "undetermined", "unknown": "undetermined"}, F.lit("undetermined"), "form type")


def form_section(text: Column) -> Column:
    return _choice(text, "_", {k: k for k in ("capital_gains", "income", "tax_credits", "additional_fields")}, None, "form section")


def field_status(text: Column) -> Column:
    names = {"computed_via_tool": "computed_via_tool", "tool": "computed_via_tool", "computed_via_rag": "computed_via_rag", "rag": "computed_via_rag", "user_override": "user_override", "override": "user_override"}
    return _choice(text, "_", names, None, "field status")


#: Letters whose one capital Java knows only as several letters.
_CAPITALS = {"ß": "ẞ", **{c.lower(): c for c in map(chr, range(0x1F80, 0x2000)) if unicodedata.category(c) == "Lt"}}


def capital(letter: Column) -> Column:
    """A letter's capital, always one letter; a letter without one stays."""
    one = F.translate(letter, "".join(_CAPITALS), "".join(_CAPITALS.values()))
    return F.when(F.length(F.upper(one)) == 1, F.upper(one)).otherwise(one)


def small(text: Column) -> Column:
    """Small letters, one for each, whatever stands beside it."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def calmed(text: Column) -> Column:
    """Words all in capitals (two letters or more) with only their first one left."""
    words = F.transform(F.split(text, " ", -1), lambda w: F.when(w.rlike(r"^[^a-z]*[A-Z][^a-z]*$") & (F.length(w) > 1), F.concat(capital(F.substring(w, 1, 1)), small(F.substring(w, F.lit(2), F.length(w))))).otherwise(w))
    return F.array_join(words, " ")


def text_sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def preview(text: Column, length: int = 120) -> Column:
    return F.translate(F.substring(text, 1, length), "\n", " ")


def history_line(role: Column, content: Column) -> Column:
    return F.concat(F.initcap(role), F.lit(": "), content)


def ranked_evidence(rank: Column, document: Column, page: Column, content: Column) -> Column:
    return F.format_string("[%d] %s, page %d: %s", rank, document, page, content)


def jurisdiction(text: Column) -> Column:
    """Country aliases by one name; other names lower-cased."""
    s = F.lower(F.trim(text))
    return F.when(s.isin("it", "ita", "italia", "italy"), "italy").when(s.isin("ie", "irl", "eire", "ireland"), "ireland").otherwise(s)
