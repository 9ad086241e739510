"""Operator 4, personal data, with DataFrame functions only.

Regular expressions propose spans, checksums and ranges confirm them, and the
words near a span, before and after it, move its score up or down. A span of an
added kind stays if its score reaches THRESHOLD; those of the first four kinds
stay whatever their score, which is given with them. Everything is row-local:
no shuffle, no Python on the executors. Where the matches lie follows from the
pieces between them: split() and regexp_extract_all() cut a text at the same
places, so ends are running sums of lengths, in code points. These sums, the
contexts and the masking take work in proportion to the text, however many
matches it has (cutting.py).

The expressions are written so that Java neither backtracks nor rescans a run:
a match may start only where the match before ended or a run begins, which
changes no leftmost match, and quantifiers are possessive where nothing that
follows could need a character back.

Null and empty texts have no spans. Failing matches are dropped and not
retried. Repeated rows give repeated rows; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .cutting import between, bound, pieces, scanned

#: Characters before and after a span that are searched for context words.
BEFORE, AFTER = 48, 24
#: Scores are hundredths: what context adds or takes, and what an added kind needs.
RAISED, LOWERED, THRESHOLD = 30, 20, 50
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Characters of an IBAN by country.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
#: As printed, in groups, or in one run; each country's own length.
_IBAN = "(?:" + "|".join(rf"{c}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for c, n in IBAN_LENGTHS.items()) + ")"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: proposal, a literal every match holds, the score without context, beginnings of words that raise and that lower it."""

    name: str
    pattern: str
    literal: str
    score: int
    raises: str
    lowers: str


#: The first four are asked for, in this order; the others are added.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 70, "e?mail|contact|write|reach", "example|sample"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", ".", 60, "ip|host|server|address|login", "version|release|section|chapter"),
    Kind("card", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++", "", 60, "card|visa|credit|pay|account", "order|invoice|tracking|isbn"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 60, "phone|tel|call|mobile|fax", "order|invoice|score"),
    Kind("iban", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}}){_IBAN}(?![A-Za-z0-9])", "", 60, "iban|account|bank|konto", "part|order|invoice"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "-", 30, "ssn|social security|taxpayer", "example|order|invoice"),
)
BASE = tuple(k.name for k in KINDS[:4])

_OCTET = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check of payment cards."""
    n = F.length(digits)

    def added(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), added) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces passes its check."""

    def added(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(added(a, c))) == 1


def confirmed(kind: Kind, value: Column) -> Column:
    """What a match must pass to be a span."""
    if kind.name == "ip":
        return value.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$")
    if kind.name == "card":
        digits = F.regexp_replace(value, "[ -]", "")
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind.name == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    if kind.name == "iban":
        return mod97(F.translate(value, " ", ""))
    return F.lit(True)


_SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:string,score:double>>"


def _near(words: str) -> str:
    return f"(?:^|[^a-z])(?:{words})"


def hundredths(kind: Kind, context: Column) -> Column:
    """The score of a confirmed span amid its context."""
    return F.lit(kind.score) + F.when(context.rlike(_near(kind.raises)), RAISED).otherwise(0) - F.when(context.rlike(_near(kind.lowers)), LOWERED).otherwise(0)


def lengths_of(kind: Kind, text: Column, matches: Column) -> Column:
    """For each match of a kind in a text, the code points from the end of the match before to its own end."""
    gaps = F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(matches))
    return F.zip_with(gaps, matches, lambda g, m: (F.length(g) + F.length(m)).cast("long"))


def confirmed_of(kind: Kind, matches: Column, ends: Column) -> Column:
    """The matches of a kind that are confirmed, as (kind, start, end, value), by start; ends: where the matches end."""
    span = lambda m, e: F.struct(F.lit(kind.name).alias("kind"), (e - F.length(m)).alias("start"), e.alias("end"), m.alias("value"))
    return F.filter(F.zip_with(matches, ends, span), lambda x: confirmed(kind, x["value"]))


def scored(spans: Column, cut: Column) -> Column:
    """Confirmed spans with their scores, without those of added kinds whose score is too low; cut: the text's pieces."""

    def score(kind: Kind, near: Column) -> Column:
        own = hundredths(kind, near)
        return own if kind.name in BASE else F.when(own >= THRESHOLD, own)

    def told(x: Column, cut: Column) -> Column:
        around = F.concat(between(cut, F.greatest(x["start"] - BEFORE, F.lit(0).cast("long")), x["start"]), F.lit("\n"), between(cut, x["end"], x["end"] + AFTER))
        points = bound(F.translate(around, _UPPER, _LOWER), lambda near: F.coalesce(*(F.when(x["kind"] == k.name, score(k, near)) for k in KINDS)))
        return x.withField("score", points / 100)

    return F.filter(bound(cut, lambda cut: F.transform(spans, lambda x: told(x, cut))), lambda x: x["score"].isNotNull()).cast(_SPANS)


def personal_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with spans: (kind, start, end, value, score) by kind as listed, then start; a column of that name gives way."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    found = docs.withColumns({
        f"_{k.name}": F.when(text.contains(k.literal) if k.literal else F.lit(True), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
        for k in KINDS
    })
    some = F.greatest(*(F.size(f"_{k.name}") for k in KINDS)) > 0
    found = found.withColumn("_cut", F.when(some, pieces(text)).otherwise(F.array().cast("array<string>")))
    # One expression adds up for all kinds.
    lengths = F.array(*(lengths_of(k, text, F.col(f"_{k.name}")) for k in KINDS))
    found = found.withColumn("_ends", F.transform(F.when(some, lengths).otherwise(F.array().cast("array<array<bigint>>")), lambda own: scanned(own, lambda a, b: a + b)))
    told = found.withColumn("_told", F.concat(*(confirmed_of(k, F.col(f"_{k.name}"), F.get("_ends", F.lit(n))) for n, k in enumerate(KINDS))))
    spans = told.withColumn("spans", F.when(some, scored(F.col("_told"), F.col("_cut"))).otherwise(F.array().cast(_SPANS)))
    return spans.drop("_cut", "_ends", "_told", *(f"_{k.name}" for k in KINDS))


def masked(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with the spans of its text replaced by [kind]; any column names may stand.

    Spans that overlap are one, named by the first of them (the longest of those that start there), so that nothing of any is left.
    """
    mine = [f"_{k}" for k in range(len(docs.columns))]
    body = mine[docs.columns.index(text_column)]
    spans = personal_spans(docs.toDF(*mine), text_column=body)
    text, zero = F.coalesce(F.col(body), F.lit("")), F.lit(0).cast("long")
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))

    def replaced(ordered: Column, upto: Column, cut: Column) -> Column:
        """upto: how far the spans up to and with each reach; a span that starts there or later is the first of a run."""
        told = F.transform(ordered, lambda x, k: F.struct(F.when(k == 0, zero).otherwise(F.get(upto, k - 1)).alias("before"), x["start"].alias("start"), x["kind"].alias("kind")))
        heads = F.filter(told, lambda x: x["start"] >= x["before"])
        return F.concat(
            F.array_join(F.transform(heads, lambda x: F.concat(between(cut, x["before"], x["start"]), F.lit("["), x["kind"], F.lit("]"))), ""),
            between(cut, F.element_at(upto, -1), F.length(text).cast("long")),
        )

    reach = scanned(F.transform(ordered, lambda x: -x["back"]), lambda a, b: F.greatest(a, b))
    walked = bound(ordered, lambda o: bound(reach, lambda upto: bound(pieces(text), lambda cut: replaced(o, upto, cut))))
    out = spans.withColumn(body, F.when(F.size("spans") > 0, walked).otherwise(F.col(body)))
    return out.select(*(F.col(a).alias(b) for a, b in zip(mine, docs.columns, strict=True)))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = personal_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    told = "array_join(transform({}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    base = f"filter(spans, x -> x.kind IN {BASE})"
    return spans.selectExpr(
        "doc_id", *(f"CAST(size(filter(spans, x -> x.kind = '{k}')) AS BIGINT) AS n_{k}" for k in BASE), f"sha2({told.format(base)}, 256) AS base_sha256", f"{told.format('spans')} AS spans",
        "array_join(transform(spans, x -> CAST(round(x.score * 100) AS INT)), ',') AS scores",
    )


def _oracle() -> str:
    """The same in DuckDB's SQL, whose expressions never backtrack and so stay plain."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "iban": _IBAN,
    }
    digits, code = "regexp_replace(m, '[ -]', '', 'g')", "ascii(c)"
    luhn_sql = f"len({digits}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, len({digits}) + 1), lambda i: CASE WHEN (len({digits}) - i) % 2 = 1 THEN (2 * CAST({digits}[i] AS INT)) // 10 + (2 * CAST({digits}[i] AS INT)) % 10 ELSE CAST({digits}[i] AS INT) END)) % 10 = 0"
    run = "replace(m, ' ', '')"
    number = f"array_to_string(list_transform(string_split({run}[5:] || {run}[:4], ''), lambda c: CASE WHEN {code} >= 65 THEN CAST({code} - 55 AS VARCHAR) ELSE c END), '')"
    passes = {
        "ip": "list_max(list_transform(string_split(m, '.'), lambda p: CAST(p AS HUGEINT))) <= 255", "card": luhn_sql, "phone": "len(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 8 AND 15",
        "iban": f"NOT regexp_matches(substring(t, s, 1) || substring(t, e + 1, 1), '[A-Za-z0-9]') AND list_reduce(list_transform(string_split({number}, ''), lambda c: CAST(c AS INT)), lambda a, d: (a * 10 + d) % 97) = 1",
    }
    parts = []
    for n, k in enumerate(KINDS):
        p = plain.get(k.name, k.pattern)
        score = f"{k.score} + CASE WHEN regexp_matches(near, '{_near(k.raises)}') THEN {RAISED} ELSE 0 END - CASE WHEN regexp_matches(near, '{_near(k.lowers)}') THEN {LOWERED} ELSE 0 END"
        parts.append(f"""
  SELECT doc_id, n, kind, s, e, score FROM (SELECT doc_id, {n} AS n, '{k.name}' AS kind, s, e, {score} AS score FROM (
    SELECT *, translate(substring(t, greatest(s - {BEFORE}, 0) + 1, least({BEFORE}, s)) || chr(10) || substring(t, e + 1, {AFTER}), '{_UPPER}', '{_LOWER}') AS near FROM (
      SELECT doc_id, t, m, CAST(e - len(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM (
        SELECT doc_id, t, m, sum(len(m) + len(gap)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
          SELECT doc_id, t, unnest(ms) AS m, unnest(gaps[:len(ms)]) AS gap, unnest(range(len(ms))) AS i FROM (
            SELECT doc_id, t, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gaps FROM d))))
    WHERE {passes.get(k.name, 'true')})) WHERE n < {len(BASE)} OR score >= {THRESHOLD}""")
    told = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY n, s)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({' UNION ALL '.join(parts)})
SELECT d.doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY n, s) FILTER (n < 4), '')) AS base_sha256,
  coalesce({told}, '') AS spans, coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY n, s), '') AS scores
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""


ORACLE = _oracle()
