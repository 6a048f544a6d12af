"""Personal data: regular expressions propose spans, checks confirm them, nearby
words adjust their score. DataFrame functions only.

The base kinds have fixed patterns and leftmost non-overlapping matches; the patterns
below are written so that Java's matcher needs time in proportion to the text, with
the same matches. A proposed match of these that fails its check is dropped, without a second
try inside it. The method adds two kinds, ``iban`` (mod 97; looked for at every place
where one can begin, with every end at a space) and ``phone_local`` (only with a word for
telephone shortly before it); base spans always stay.

Defined results: a null text counts as empty; a text without matches has an empty
list; repeated rows each have their own result; extra columns are ignored. Places are
code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans are listed. A match begins at the start of a run
#: of its characters or where the match before ended (``\G``): a later start in the
#: run has the same rest before it and fails as well.
BASE = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11})",
    "phone_local": r"(?<![0-9+(.-])\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
#: What a text must hold for a kind to be looked for at all.
NEEDED = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "phone_local": r"[0-9][\x20./-][0-9]"}
#: Whole words of an account number and what may follow it, at its place.
_RUN = r"^[A-Z]{2}[0-9]{2}[A-Z0-9]*+(?![a-z])(?:\x20[A-Z0-9]++(?![a-z]))*"
#: Signs of an account number by country; of others, the least and the most. Characters
#: that the longest can take with a space after each sign.
_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
LENGTH = {country: n for n, countries in _LENGTHS.items() for country in countries.split()}
SHORTEST, LONGEST = 15, 34
_WIDTH = 2 * LONGEST
#: Characters before a span that are searched for context words, and the words.
NEAR = 40
CONTEXT = {
    "email": r"(?i)\b(e-?mail|mail|contact|correo|courriel)",
    "ip": r"(?i)\b(ip|address|host|server|login|adresse)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)",
    "phone": r"(?i)\b(tel|phone|call|fax|mobile|telefon|telephone|llamar)",
    "iban": r"(?i)\b(iban|account|bank|konto|compte|cuenta)",
    "phone_local": r"(?i)\b(tel|phone|call|fax|mobile|telefon|telephone|llamar)",
}
#: Score of a confirmed span, what a context word adds, and the score that is needed.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "phone_local": 0.3}
BOOST, LEAST = 0.3, 0.5

_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    """Whether an account number has remainder 1 modulo 97, letters counting 10 to 35."""
    code = F.upper(F.regexp_replace(m, r"\x20", ""))
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
    signs = F.filter(F.split(turned, ""), lambda c: c != "")

    def step(acc, c):
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.when(v > 9, (acc * 100 + v) % 97).otherwise((acc * 10 + v) % 97)

    return F.aggregate(signs, F.lit(0), step) == 1


def confirmed(kind: str, m: Column) -> Column:
    """The check that a proposed match of a kind has to pass."""
    if kind == "ip":
        return m.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        d = _digits(m)
        # the length is looked at first: the checksum is for short numbers
        return F.when(F.length(d).between(13, 19), F.call_function("luhn_check", d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return _mod97(m)
    if kind == "phone_local":
        return F.length(_digits(m)).between(8, 12)
    return F.lit(True)


SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


#: Matches that are folded into one array. A match is added by copying the array, so a
#: text's matches are folded in blocks, whose arrays are joined once at the end.
BLOCK = 256


def _folded(n: Column, zero: Column, state: str, step, out: str, most: int = BLOCK) -> Column:
    """Fold over 0 .. n - 1 (n > 0) and list what the steps find: ``step(state, i)`` gives the
    next state and an array. Above ``most`` steps the states between blocks are found first,
    then each block lists its own."""
    both = f"struct<state:{state},found:{out}>"

    def block(start: Column, first: Column, last: Column) -> Column:
        def add(acc, i):
            new, found = step(acc["state"], i)
            return F.struct(new.alias("state"), F.concat(acc["found"], found).alias("found")).cast(both)

        return F.aggregate(F.sequence(first, last), F.struct(start.alias("state"), F.array().cast(out).alias("found")).cast(both), add, lambda acc: acc["found"])

    blocks = F.sequence(F.lit(0), F.floor((n - 1) / most).cast("int"))
    bounds = lambda b: (b * most, F.least((b + 1) * most, n) - 1)
    heads = f"struct<state:{state},heads:array<{state}>>"

    def head(acc, b):
        after = F.aggregate(F.sequence(*bounds(b)), acc["state"], lambda at, i: step(at, i)[0].cast(state))
        return F.struct(after.alias("state"), F.concat(acc["heads"], F.array(acc["state"])).alias("heads")).cast(heads)

    begin = F.struct(zero.alias("state"), F.array().cast(f"array<{state}>").alias("heads")).cast(heads)
    starts = F.aggregate(blocks, begin, head, lambda acc: acc["heads"])
    parts = F.transform(starts, lambda start, b: block(start, *bounds(b)))
    return F.when(n <= most, block(zero, F.lit(0), n - 1)).otherwise(F.flatten(parts))


def _last(before: Column, more: Column) -> Column:
    """The last ``NEAR`` characters of a text that goes on."""
    both = F.concat(before, F.substring(more, F.greatest(F.length(more) - NEAR + 1, F.lit(1)), F.lit(NEAR)))
    return F.substring(both, F.greatest(F.length(both) - NEAR + 1, F.lit(1)), F.lit(NEAR))


def _spans(df: DataFrame, text: str, kind: str) -> DataFrame:
    """Add column ``pii_<kind>``: confirmed spans of a kind. Places come from the
    lengths of the matches and of what lies between them."""
    pattern = PATTERNS[kind]
    t, m, g, out = F.col(text), f"_{kind}_m", f"_{kind}_g", f"pii_{kind}"
    none = F.array().cast("array<string>")
    has = t.rlike(NEEDED[kind])
    df = df.withColumn(m, F.when(has, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(g, F.when(F.size(m) > 0, F.split(t, pattern, -1)).otherwise(none))
    state = "struct<at:bigint,before:string>"

    def step(acc, i):
        gap, hit = F.get(F.col(g), i), F.get(F.col(m), i)
        start = acc["at"] + F.length(gap)
        end = start + F.length(hit)
        near = _last(acc["before"], gap)  # of the whole text, matches included
        score = F.lit(SCORE[kind]) + F.when(near.rlike(CONTEXT[kind]), BOOST).otherwise(0.0)
        keep = confirmed(kind, hit) if kind in BASE else confirmed(kind, hit) & (score >= LEAST)
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.least(score, F.lit(1.0)).alias("score"))
        return F.struct(end.alias("at"), _last(near, hit).alias("before")), F.when(keep, F.array(span)).otherwise(F.array().cast(SPAN))

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("before")).cast(state)
    found = _folded(F.size(m), zero, state, step, SPAN)
    return df.withColumn(out, F.when(F.size(m) > 0, found).otherwise(F.array().cast(SPAN))).drop(m, g)


def _iban_at(ahead: Column) -> Column:
    """The account number that a text begins with, or null: of the ends at a space whose
    remainder is right, the one of the country's length, else the farthest."""
    run = F.split(F.regexp_extract(ahead, _RUN, 0), " ")
    signs = lambda m: F.length(F.regexp_replace(m, r"\x20", ""))
    ends = F.transform(F.sequence(F.lit(1), F.size(run)), lambda i: F.array_join(F.slice(run, F.lit(1), i), " "))
    right = F.filter(ends, lambda m: F.when(signs(m).between(SHORTEST, LONGEST), confirmed("iban", m)).otherwise(False))
    lengths = F.create_map(*[F.lit(x) for pair in LENGTH.items() for x in pair])
    usual = F.filter(right, lambda m: signs(m) == F.try_element_at(lengths, F.substring(m, 1, 2)))
    return F.coalesce(F.get(usual, F.lit(0)), F.try_element_at(right, F.lit(-1)))


def _ibans(df: DataFrame, text: str, kind: str = "iban") -> DataFrame:
    """Add column ``pii_iban``. The text is cut at every place where an account number
    can begin; it may reach over later cuts, which are passed over then."""
    t, g, out = F.col(text), f"_{kind}_g", f"pii_{kind}"
    # a text that begins with an account number has no cut there, so a sign goes before it
    df = df.withColumn(g, F.when(t.rlike(PATTERNS[kind]), F.split(F.concat(F.lit(" "), t), PATTERNS[kind], -1)).otherwise(F.array().cast("array<string>")))
    state = "struct<at:bigint,past:bigint,before:string>"
    reach = _WIDTH // 5 + 2  # a cut is at least five characters before the next

    def step(acc, i):
        part = F.get(F.col(g), i)
        heads = F.transform(F.slice(F.col(g), i + 1, F.lit(reach)), lambda p: F.substring(p, 1, _WIDTH))
        hit = F.when((i > 0) & (acc["at"] >= acc["past"]), _iban_at(F.substring(F.array_join(heads, ""), 1, _WIDTH)))
        end = acc["at"] + F.length(hit)
        score = F.lit(SCORE[kind]) + F.when(acc["before"].rlike(CONTEXT[kind]), BOOST).otherwise(0.0)
        span = F.struct(F.lit(kind).alias("kind"), acc["at"].alias("start"), end.alias("end"), F.least(score, F.lit(1.0)).alias("score"))
        new = F.struct((acc["at"] + F.length(part)).alias("at"), F.coalesce(end, acc["past"]).alias("past"), _last(acc["before"], part).alias("before"))
        return new, F.when(hit.isNotNull() & (score >= LEAST), F.array(span)).otherwise(F.array().cast(SPAN))

    zero = F.struct(F.lit(-1).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("past"), F.lit("").alias("before")).cast(state)
    found = _folded(F.size(g), zero, state, step, SPAN)
    return df.withColumn(out, F.when(F.size(g) > 0, found).otherwise(F.array().cast(SPAN))).drop(g)


def find_pii(df: DataFrame, text: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """Add ``pii_<kind>`` (spans by start) for each kind; the text column must not be
    null."""
    for kind in kinds:
        df = _ibans(df, text) if kind == "iban" else _spans(df, text, kind)
    return df


def redacted(text: Column, spans: Column) -> Column:
    """Text with each span replaced by its kind in brackets; of overlapping spans the
    one that starts first counts (ties: the longer one)."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("stop"), s["kind"].alias("kind"))))
    piece = "array<struct<start:bigint,stop:bigint,end:bigint,mark:string>>"
    zero = F.lit(0).cast("bigint")

    def once(value: Column, then) -> Column:
        """``then`` of a value that is worked out once."""
        return F.get(F.transform(F.array(value), then), F.lit(0))

    def pieces(ordered: Column) -> Column:
        """What is left before each span that counts, with the span's end and mark."""

        def step(at, i):
            s = F.get(ordered, i)
            mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
            found = F.array(F.struct(at.alias("start"), s["start"].alias("stop"), (-s["stop"]).alias("end"), mark.alias("mark")))
            return F.when(s["start"] < at, at).otherwise(-s["stop"]), F.when(s["start"] < at, F.array().cast(piece)).otherwise(found)

        return _folded(F.size(ordered), zero, "bigint", step, piece)

    def cut(t: Column, start: Column, stop: Column) -> Column:
        return F.substring(t, (start + 1).cast("int"), (stop - start).cast("int"))

    def written(some: Column) -> Column:
        # a part of the text is cut out for each block of spans, as a cut walks from the start
        def block(b):
            mine = F.slice(some, b * BLOCK + 1, F.lit(BLOCK))
            return once(mine, lambda own: once(cut(text, F.get(own, F.lit(0))["start"], F.element_at(own, -1)["stop"]), lambda part: F.array_join(
                F.transform(own, lambda p: F.concat(cut(part, p["start"] - F.get(own, F.lit(0))["start"], p["stop"] - F.get(own, F.lit(0))["start"]), p["mark"])), "")))

        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(some) - 1) / BLOCK).cast("int")), block)
        return F.concat(F.array_join(blocks, ""), F.substring(text, (F.element_at(some, -1)["end"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) > 0, once(by_start, lambda o: once(pieces(o), written))).otherwise(text)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii(docs: DataFrame) -> DataFrame:
    found = find_pii(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    base = F.concat(*[F.col(f"pii_{k}") for k in BASE])
    every = F.concat(*[F.col(f"pii_{k}") for k in PATTERNS])
    return found.select(
        "doc_id",
        *[F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        F.transform(every, lambda s: F.round(s["score"], 2)).alias("scores"),
    )
