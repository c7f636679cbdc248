"""Personal data by weak supervision, with DataFrame functions alone.

Base spans are the leftmost non-overlapping matches of one expression per kind that pass its check; they always stay.
Looser expressions propose further spans. Four labelers vote on every proposal (yes, no or nothing): the form of the
string, a gazetteer (top-level domains, reserved addresses, issuers, calling codes, given names), the words in front of
it, and the characters next to it. All proposals of the corpus are counted by kind, votes and length class, a table
whose size does not depend on the corpus. On it, expectation-maximisation estimates each labeler's reliability, and a
logistic span classifier is trained on the resulting chances. Proposals that it accepts join the base spans, unless they
overlap one.

Offsets are code points, ends exclusive. A text is scanned a fixed number of times by expressions without nested
repetition, so long texts stay linear; matches and the text between them give the offsets, summed in pages.

Nulls and ties: a null text counts as empty and has no spans; repeated rows get the same result each; two accepted
proposals never overlap, being matches of one expression. An empty table gives no rows. Columns other than the
key and the text are kept where a text is redacted, and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import every_column, materialize

#: Kinds in the order of results; the last three have no base expression.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "person", "ssn")
#: How many matches a page of running sums holds.
PAGE = 128
CONTEXT = 32
#: A proposal is accepted from this chance on.
ACCEPT = 0.5

_LOCAL = "A-Za-z0-9._%+-"
#: The base expressions, written so that no start inside a run is tried twice; they match what the plain ones match.
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a base expression to be tried.
HOLDS = {"email": "@", "phone": "+"}
#: Looser expressions, by kind; one scan tries them all where a word begins.
LOOSE = {
    "email": r"[A-Za-z0-9._%-]{1,64}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]{1,63}+){1,4}+",
    "ip": r"(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])",
    "phone": r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "person": r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra?)\.? \p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)?",
}
#: Strings that a base expression takes come first, so that a looser one starts behind them.
LOOSE_SCAN = (
    r"\+[0-9][\x20().0-9-]+[0-9]|(?<![A-Za-z0-9+])(?:[0-9](?:[\x20-]?[0-9]){15,}+|[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++|" + "|".join(LOOSE.values()) + ")"
)

# Gazetteers.
DOMAINS = "com org net edu gov mil int info biz io co de fr es en uk it nl at ch be eu us ca au jp cn in br mx ru pl se no dk fi pt ie"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|64[4-9]|65|62)"
CALLING_CODES = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
RESERVED = r"^(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|22[4-9]|2[3-5][0-9])\."
NAMES = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen "
    "Hans Peter Wolfgang Klaus Jürgen Anna Maria Ursula Monika Petra Jean Pierre Michel Philippe Marie Nathalie Isabelle Sylvie Jose Antonio Manuel "
    "Francisco Juan Carmen Ana Isabel Dolores Pilar Paul Daniel Mark George Laura Emma Lucas Sofia Martin Thomas"
)
IBAN_COUNTRIES = "AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IL|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SA|SE|SI|SK|SM|TR"
# Words in front of a span that speak for its kind, and words that speak against any.
CUES = {
    "email": "e-?mail|mail|contact|kontakt|correo|courriel|write to|from|to",
    "ip": r"\bip|address|host|server|client|login|adresse",
    "card": "card|visa|master|amex|credit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|cell|fax|telefon|handy|téléphone|teléfono|dial|whatsapp",
    "iban": "iban|account|konto|compte|cuenta|bank",
    "person": "name|from|by|dear|signed|von|par|por|sincerely",
    "ssn": "ssn|social|security|tax|insurance",
}
AGAINST = r"version|release|isbn|issn|order|invoice|serial|part no|build|section|chapter|doi|ticket|sku"

LABELERS = ("form", "gazetteer", "context", "border")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes; the sum runs over each digit with its place from the right."""
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def term(place: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - place + 1, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(place % 2 == 1, digit).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    total = F.aggregate(F.transform(places, term), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))
    return (F.length(digits) > 0) & (total % 10 == 0)


def _mod97(code: Column) -> Column:
    """Whether an IBAN without blanks passes: its first four signs go last, letters count from 10, and the number leaves 1."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
    signs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(code), F.lit(1))), lambda place: F.ascii(F.substring(turned, place, F.lit(1))))
    rest = F.aggregate(signs, F.lit(0), lambda left, sign: F.when(sign >= 65, left * 100 + sign - 55).otherwise(left * 10 + sign - 48) % 97)
    return rest == 1


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    """The check of a base kind."""
    if kind == "ip":
        # Four digits tell that a part is too large, whatever follows.
        size = lambda part: F.coalesce(F.substring(F.regexp_replace(part, "^0+", ""), 1, 4).try_cast("int"), F.lit(0))
        return F.forall(F.split(value, r"\."), lambda part: size(part) <= 255)
    count = F.length(_digits(value))
    if kind == "card":
        # Other lengths never pay for the sum.
        return F.when(count.between(16, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return count.between(8, 15)
    return F.lit(True)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """New columns behind a generator, so that each is computed once however often it is used."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _running(lengths: Column) -> Column:
    """The sum of all elements before each, in pages so that the work stays near linear."""
    pages = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(lengths) - 1) / PAGE).cast("int"))),
        lambda p: F.slice(lengths, p * PAGE + 1, PAGE),
    )
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    summed = F.transform(pages, lambda page: F.struct(page.alias("page"), total(page).alias("sum")))
    # Sums of whole pages before each page, kept as an array that grows page by page.
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<page:array<bigint>,at:bigint>>").alias("done"))
    placed = F.aggregate(
        summed, start,
        lambda acc, s: F.struct(
            (acc["at"] + s["sum"]).alias("at"), F.concat(acc["done"], F.array(F.struct(s["page"].alias("page"), acc["at"].alias("at")))).alias("done")
        ),
    )["done"]
    inside = lambda d: F.transform(d["page"], lambda _, i: d["at"] + total(F.slice(d["page"], 1, i)))
    return F.flatten(F.transform(placed, inside))


_MATCH = "struct<value:string,start:bigint,end:bigint,before:string,after:string>"


def _found(df: DataFrame, pattern: str, name: str, keep, holds: Column | None = None) -> DataFrame:
    """The frame with an array `name` of matches: value, start, end, and what stands before and after."""
    values = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    values = values if holds is None else F.when(holds, values).otherwise(F.array().cast("array<string>"))
    df = _once(df, _values=values)
    gaps = F.when(F.size("_values") > 0, F.split("text", pattern, -1)).otherwise(F.array().cast("array<string>"))
    df = _once(df, _gaps=gaps)
    sizes = F.transform(F.arrays_zip("_gaps", "_values"), lambda p: (F.length(p["_gaps"]) + F.coalesce(F.length(p["_values"]), F.lit(0))).cast("long"))
    df = _once(df, _before=F.when(F.size("_values") > 0, _running(sizes)).otherwise(F.array().cast("array<bigint>")))

    def match(value: Column, i: Column) -> Column:
        gap, start = F.get("_gaps", i), F.get("_before", i) + F.length(F.get("_gaps", i))
        return F.struct(
            value.alias("value"), start.cast("long").alias("start"), (start + F.length(value)).cast("long").alias("end"),
            F.substring(gap, -CONTEXT, CONTEXT).alias("before"), F.substring(F.get("_gaps", i + 1), 1, 1).alias("after"),
        )

    return _once(df, **{name: F.filter(F.transform("_values", match), keep)}).drop("_values", "_gaps", "_before")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(-1).cast("int")


def _any_of(words: str) -> str:
    return rf"(?:{'|'.join(words.split())})"


def _judged(kind: str, match: Column, valid: Column, base: Column) -> Column:
    """The proposal with the votes of all labelers."""
    value, before = match["value"], F.lower(match["before"])
    gazetteer = {
        "email": _vote(F.lower(value).rlike(rf"(?:\.|dot[\])] ?){_any_of(DOMAINS)}$"), F.lit(False)),
        "ip": _vote(~value.rlike(RESERVED) & value.contains("."), value.rlike(RESERVED)),
        "card": _vote(_digits(value).rlike(ISSUERS), ~_digits(value).rlike(ISSUERS)),
        "phone": _vote(value.rlike(CALLING_CODES), F.lit(False)),
        "iban": _vote(value.rlike(rf"^(?:{IBAN_COUNTRIES})"), ~value.rlike(rf"^(?:{IBAN_COUNTRIES})")),
        "person": _vote(value.rlike(rf" {_any_of(NAMES)}(?: |$)"), F.lit(False)),
        "ssn": _vote(F.lit(False), value.rlike("^(?:000|666|9[0-9]{2})|-00-|-0000$")),
    }[kind]
    context = _vote(before.rlike(rf"(?:{CUES[kind]})\W*\w*\W*$"), before.rlike(rf"(?:{AGAINST})\W*\w*\W*$"))
    last, alnum = F.substring(match["before"], -1, 1), r"[\p{L}\p{Nd}]"
    border = _vote(~(last.rlike(alnum) | match["after"].rlike(alnum)), last.rlike(alnum) | match["after"].rlike(alnum))
    size = F.when(F.length(value) <= 12, 0).when(F.length(value) <= 20, 1).otherwise(2)
    return F.struct(
        F.lit(kind).alias("kind"), match["start"].alias("start"), match["end"].alias("end"), base.alias("base"),
        _vote(valid, ~valid).alias("form"), gazetteer.alias("gazetteer"), context.alias("context"), border.alias("border"), size.cast("int").alias("size"),
    )


def _loose_valid(kind: str, value: Column) -> Column:
    """The form labeler of looser proposals: a check digit where there is one."""
    if kind == "card":
        return _luhn(_digits(value))
    if kind == "iban":
        code = F.regexp_replace(value, " ", "")
        return F.length(code).between(15, 34) & _mod97(code)
    return F.lit(True)


def proposals(docs: DataFrame, *, key: str = "doc_id", text: str = "text", whole_rows: bool = False) -> DataFrame:
    """(id, found): every row with its proposals, base ones flagged.

    With `whole_rows` each row also comes along as the struct `row`; else no text does.
    """
    carried = [F.struct(*every_column(docs)).alias("row")] if whole_rows else []
    df = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *carried)
    # A match far from valid is no proposal; one that fails its check is, as evidence against.
    near = {
        "email": lambda m: F.lit(True),
        "ip": lambda m: F.lit(True),
        "card": lambda m: F.length(_digits(m["value"])).between(16, 19),
        "phone": lambda m: F.length(_digits(m["value"])).between(6, 15),
    }
    for kind in BASE_KINDS:
        df = _found(df, BASE[kind], f"_{kind}", near[kind], F.col("text").contains(HOLDS[kind]) if kind in HOLDS else None)
    exactly = {kind: f"^(?:{pattern})$" for kind, pattern in LOOSE.items()}
    taken = "|".join([r"^\+", r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$", r"^[0-9](?:[\x20-]?[0-9]){15,}+$"])
    df = _found(df, LOOSE_SCAN, "_loose", lambda m: ~m["value"].rlike(taken)).drop("text")

    judged = [_judged_base(kind) for kind in BASE_KINDS]
    judged += [_judged_loose(kind, exactly) for kind in LOOSE]
    return df.select("id", F.concat(*judged).alias("found"), *["row"] * whole_rows)


def _judged_base(kind: str) -> Column:
    return F.transform(f"_{kind}", lambda m: _judged(kind, m, _valid(kind, m["value"]), _valid(kind, m["value"])))


def _judged_loose(kind: str, exactly: dict[str, str]) -> Column:
    mine = F.filter("_loose", lambda m: m["value"].rlike(exactly[kind]) & ~_earlier(m, exactly, kind))
    return F.transform(mine, lambda m: _judged(kind, m, _loose_valid(kind, m["value"]), F.lit(False)))


def _earlier(match: Column, exactly: dict[str, str], kind: str) -> Column:
    """Whether an earlier expression already claims the match."""
    claimed = F.lit(False)
    for other, pattern in exactly.items():
        if other == kind:
            return claimed
        claimed = claimed | match["value"].rlike(pattern)
    return claimed


def reliabilities(patterns: Sequence[dict], rounds: int = 50) -> tuple[list[float], dict[str, tuple[float, float]]]:
    """(chance of each pattern, {labeler: (yes if true, yes if false)}) by expectation-maximisation over counted votes.

    Shares start from, and are held by, pseudo-counts under which a labeler is right four times in five.
    """
    yes = {name: (0.8, 0.2) for name in LABELERS}
    prior = {kind: 0.5 for kind in KINDS}
    chances = [0.5] * len(patterns)
    for _ in range(rounds):
        for at, p in enumerate(patterns):
            true, false = prior[p["kind"]], 1.0 - prior[p["kind"]]
            for name in LABELERS:
                if p[name] >= 0:
                    true *= yes[name][0] if p[name] else 1.0 - yes[name][0]
                    false *= yes[name][1] if p[name] else 1.0 - yes[name][1]
            chances[at] = true / (true + false)
        for name in LABELERS:
            counts = [[8.0, 10.0], [2.0, 10.0]]
            for p, chance in zip(patterns, chances):
                if p[name] >= 0:
                    for side, share in ((0, chance), (1, 1.0 - chance)):
                        counts[side][0] += share * p["n"] * p[name]
                        counts[side][1] += share * p["n"]
            yes[name] = tuple(min(0.99, max(0.01, a / b)) for a, b in counts)
        for kind in KINDS:
            mass = [(c * p["n"], p["n"]) for p, c in zip(patterns, chances) if p["kind"] == kind]
            prior[kind] = (1.0 + sum(m for m, _ in mass)) / (2.0 + sum(n for _, n in mass))
    return chances, yes


def _names(p: dict) -> list[str]:
    """The features of a pattern that are on."""
    return ["always", f"kind={p['kind']}", f"size={p['size']}", *(f"{name}={p[name]}" for name in LABELERS)]


def span_classifier(patterns: Sequence[dict], chances: Sequence[float], rounds: int = 25) -> dict[str, float]:
    """Weights of a logistic regression on kind, votes and length class, fitted to the chances by Newton's method."""
    names = sorted({name for p in patterns for name in _names(p)})
    at = {name: i for i, name in enumerate(names)}
    x = np.zeros((len(patterns), len(names)))
    for row, p in enumerate(patterns):
        x[row, [at[name] for name in _names(p)]] = 1.0
    weight, target, beta = np.array([float(p["n"]) for p in patterns]), np.array(chances), np.zeros(len(names))
    for _ in range(rounds):
        mean = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (target - mean)) - beta
        bend = (x * (weight * mean * (1.0 - mean))[:, None]).T @ x + np.eye(len(names))
        beta = beta + np.linalg.solve(bend, slope)
    return dict(zip(names, beta.tolist()))


def accepted(proposal: Column, weights: dict[str, float]) -> Column:
    """Whether the classifier takes a proposal."""
    total = F.lit(weights.get("always", 0.0))
    for field in ("kind", "size", *LABELERS):
        cases = {name.partition("=")[2]: w for name, w in weights.items() if name.startswith(f"{field}=")}
        if cases:
            table = F.create_map(*[F.lit(v) for pair in cases.items() for v in pair])
            total = total + F.coalesce(F.try_element_at(table, proposal[field].cast("string")), F.lit(0.0))
    return total >= float(np.log(ACCEPT / (1.0 - ACCEPT)))


def _in_order(spans: Column) -> Column:
    """By kind as listed, then by start."""
    of_kind = lambda kind: F.filter(spans, lambda s: s["kind"] == kind)
    return F.concat(*[F.array_sort(of_kind(kind), _by_start) for kind in KINDS])


def _by_start(a: Column, b: Column) -> Column:
    return F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)


def personal_data(docs: DataFrame, *, key: str = "doc_id", text: str = "text", whole_rows: bool = False) -> DataFrame:
    """(key, base, spans): base spans, and these with the accepted proposals, as structs of kind, start and end.

    With `whole_rows` each row also comes along as the struct `row`.
    """
    found = materialize(proposals(docs, key=key, text=text, whole_rows=whole_rows), "pii-proposals")
    # At most kinds x votes x length classes, some thousands of rows.
    votes = found.select(F.inline("found")).groupBy("kind", *LABELERS, "size").agg(F.count("*").alias("n"))
    patterns = sorted((r.asDict() for r in votes.collect()), key=lambda p: tuple(str(v) for v in p.values()))
    chances, _ = reliabilities(patterns)
    weights = span_classifier(patterns, chances) if patterns else {}
    split = _once(found, _base=F.filter("found", lambda s: s["base"]), _more=F.filter("found", lambda s: ~s["base"] & accepted(s, weights)))
    apart = lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    # Only what the loose scan proposes can be added: a base match that fails its check never is.
    loose = F.filter("_more", lambda s: (s["form"] == 1) & apart(s))
    plain = lambda spans: F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end")]))
    return split.select(
        F.col("id").alias(key), plain(_in_order(F.col("_base"))).alias("base"), plain(_in_order(F.concat("_base", loose))).alias("spans"),
        *["row"] * whole_rows,
    )


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; spans that overlap are replaced as one.

    Spans are found and applied within the row: nothing is joined, and rows that share a key stay apart.
    """
    found = personal_data(docs, key=key, text=text, whole_rows=True)
    value = F.col("row").getField(text)
    clean = F.when(F.size("spans") > 0, masked(value, F.col("spans"))).otherwise(value)
    return found.select(*[clean.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])


def masked(text: Column, spans: Column) -> Column:
    """The text with its spans, joined where they overlap, replaced by [KIND] of the first."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["done"], F.array(F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("done"))
        longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["done"].alias("done"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(longer)

    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(_longest_first(a, b)))
    walked = F.aggregate(ordered, start, step)
    return F.concat(F.array_join(walked["done"], ""), F.substring(text, (walked["at"] + 1).cast("int"), F.length(text)))


def _longest_first(a: Column, b: Column) -> Column:
    return F.when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0)
