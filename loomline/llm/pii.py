"""Personal information in free text: find typed spans and replace them.

Regular expressions propose spans, checksum validators (Luhn, mod-97, mod-11-10)
confirm the numbers that carry one, and the words just before a span raise or
lower its score.  A span counts from ``THRESHOLD`` upwards; of overlapping spans
the one with the higher score, then the longer, wins.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.messages import parse, placed_texts

THRESHOLD = 0.5
#: The list of known name parts is held by every task; a longer one is refused.
MOST_NAME_PARTS = 2_000_000

# Words whose presence before a span speaks for or against a type.
PHONE_WORDS = re.compile(r"(?i)\b(?:call|called|phone|tel|telephone|mobile|cell|text|pager|number is|fax|reach|desk|callback|dial|ring|T)\b\W*(?:\w+\W+){0,3}$")
ID_WORDS = re.compile(
    r"(?i)(?:\bssn|\bsocial(?: security)?|\bsoc\. ?sec\.|\btax|\bsteuer-?id(?:nr)?\.?|\bsteuernummer|\bnational (?:insurance|id)|\bnino|\bni number|\bpassport|\btravel document|\bidentity(?: card)?|\bid card|\bausweis|\bdriver'?’?s? licen[cs]e|\bdriving licen[cs]e|\blicen[cs]e)"
    r"(?: (?:number|card|security|id|no\.?|nr\.?|num\.?|#))*[\s:=#\"']*(?:is )?$"
)
CARD_WORDS = re.compile(r"(?i)\b(?:card|visa|mastercard|credit|debit)\b[\w ]{0,12}[\s:=#]*$")
NOT_ID_WORDS = re.compile(r"(?i)\b(?:trace|run|ticket|build|span|offset|byte|commit|request|job|issue|pid|port|rows?|order|version)\b[\s:=#]*$")
ADDRESS_WORDS = re.compile(r"(?i)(?:address|addr|lives at|ship|visitors|parcel|label|deliver|located|street)[^\n]{0,30}$")

EMAIL_AT = re.compile(r"@|\[at\]|\(at\)", re.I)
NO_ADDRESS_WORDS = re.compile(r"(?i)\b(?:sections?|rows?|lines?|pages?|steps?|items?|chapters?|ports?|versions?|top|first|last|next|batch|step|run|ticket|build)[ :=#]*$")
EMAIL_LOCAL = re.compile(r"(?<![\w.%+/@-])([\w](?:[\w.%+-]*[\w+-])?)(\s?)$")
EMAIL_DOMAIN = re.compile(r"( ?)([A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z]{2,24})(?![\w@])", re.I)

PHONE = re.compile(
    r"(?<![\w.+@/-])(?:"
    r"\+\d{1,3}(?:[ .-]?\(\d{1,5}\))?(?:[ .-]?\d{1,14})(?:[ .-]\d{2,6}){0,4}"
    r"|\(\d{3,5}\)[ -]?\d{3,6}(?:[ .-]\d{3,6}){0,2}"
    r"|00[1-9]\d{0,2}(?:[ -](?:\(0\))?\d{1,6}){2,5}"
    r"|\d{3}([-. ])\d{3}\1\d{4}"
    r"|0\d{2,4}[ /-]\d{3,8}(?:[ -]\d{3,6})?"
    r")(?: ?(?:x|ext\.?|extension) ?\d{1,6}\b)?(?![\w@-]|\.\d)",
    re.I,
)

ID_NUMBER = re.compile(
    r"(?<![\w.+@/-])(?:"
    r"(?P<ssn>\d{3}([- ])\d{2}\2\d{4})"
    r"|(?P<tax>\d{11}|\d{2} \d{3} \d{3} \d{3})"
    r"|(?P<nino>[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])"
    r"|(?P<card2>[A-Z]{2}-\d{3,4}-\d{3,4})"
    r"|(?P<passport>[A-Z]{1,2}\d{6,8})"
    r"|(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)"
    r"|(?P<pan>\d{4}[ -]\d{6}[ -]\d{4,5}|\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7})"
    r"|(?P<other>(?:[A-Z]{1,3}-?)?\d[\dA-Z]*(?:[- ]\d[\dA-Z]*){0,4})"
    r")(?![\w@-]|\.\d)"
)

IBAN_LOWER = re.compile(r"(?<![\w.+@/-])[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,4})?(?![\w@-]|\.\d)")
#: The first digits of payment cards.  Fixed values.
CARD_ISSUER = re.compile(r"4|5[1-5]|2[2-7]|3[0-9]|6(?:011|4|5)")

# Endings of street names.
STREET = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Drive|Dr\.?|Court|Ct\.?|Terrace|Row|Way|Close|Boulevard|Blvd\.?|Place|Pl\.?|Square|Sq\.?|Crescent|Grove|Gardens|Hill|Walk|Mews)"
CAP = r"[A-ZÀ-ÖØ-Þ][\w'’]*(?:-[A-ZÀ-ÖØ-Þ][\w'’]*)*"
TOWN = r"[A-ZÀ-ÖØ-Þ]\w+(?:['’-]\w+)*"
POSTCODE = r"(?:[A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2}|\d{5}(?:-\d{4})?)"
ADDRESS = re.compile(
    rf"(?<![\w.+@/-])\d{{1,5}}[A-Za-z]? (?:(?:[NSEW]\.?|North|South|East|West) )?(?:{CAP} ){{1,2}}{STREET}"
    rf"(?:,? (?:(?:Apt|Unit|Suite|Ste|Flat|Apartment|Floor)\.? ?#?\w+|#\w+))?(?P<town>,[ \n]{TOWN}(?:,? (?P<code>{POSTCODE}))?)?(?![\w@-])"
    rf"|(?<![\w.+@/-])\d{{1,4}}(?: ?(?:bis|ter))?,? (?i:rue|avenue|boulevard|place|chemin|quai|allée|impasse|cours) (?:de |du |des |la |le |les |l['’]|d['’])*{CAP}(?:[ -](?:de |du |des |la |le |les )*{CAP}){{0,3}}(?P<town3>,[ \n](?P<code3>\d{{5}}) {TOWN})?(?![\w@-])"
    rf"|(?<![\w-])[A-ZÄÖÜ]\w+(?:stra(?:ß|ss)e|str\.|weg|gasse|allee|platz|zeile|pfad|ring|damm|ufer|hof|steig) \d{{1,4}} ?[a-z]?(?P<town2>, (?P<code2>\d{{5}}) {TOWN})(?![\w@-])"
)

PARTICLE = r"(?:(?:van|von|vom|de|der|den|del|della|di|da|dos|du|la|le|al|el|bin|ibn|ben|ter|ten|zu|zum|zur|af|av) )*"
NAME = re.compile(rf"(?<![\w@.+/-])({CAP})(,?) ((?:[A-ZÀ-ÖØ-Þ]\. ){{0,2}})({PARTICLE})({CAP})(?![\w@]|[.+_-]\w*@)")
NAME_CUE = re.compile(
    r"(?:customer|reviewed-by:|authored-by:|signed-off-by:|author:|reporter=|contact\"?: ?\"|ask|spoke with|handing over to|according to|taken by|regards,\n|mr\.?|mrs\.?|ms\.?|dr\.?|name:|—|dear|assignee:)\s?\"?$", re.I
)
#: Capitalised words that stand before names or begin sentences and are no given names.  Fixed values.
NO_GIVEN = frozenset(
    "customer ask according regards dear mr mrs ms dr text call login see ticket run add pinned cloned visitors ship parcel send the a an my user meeting notes handing "
    "reviewed co-authored forwarded reply-to on-call and or if when we nobody please finally order number passport social steuer-id ssn nino from to by cc with warn error info "
    "section row rows apt unit north south east west st rd road street lane court".split()
)


def fold(word: str) -> str:
    """Lower case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).casefold()


@dataclass(frozen=True)
class Names:
    """Known name parts and, learned from them, the beginnings and endings that families share."""

    given: frozenset[str]
    family: frozenset[str]
    stems: frozenset[str]
    endings: frozenset[str]

    @classmethod
    def learn(cls, parts: list[tuple[str, str]]) -> Names:
        """A beginning shared by 2 known families and an ending shared by 3 can form an unlisted family."""
        given = frozenset(fold(t) for t, k in parts if t and k == "given")
        family = frozenset(fold(t) for t, k in parts if t and k == "family")
        stems, endings = Counter(), Counter()
        for f in family:
            for cut in range(2, len(f) - 2):
                stems[f[:cut]] += 1
                endings[f[cut:]] += 1
        return cls(given, family, frozenset(s for s, n in stems.items() if n >= 2), frozenset(e for e, n in endings.items() if n >= 3))

    def family_score(self, word: str) -> float:
        """1 for a known family (every part of a hyphenated one), 0.8 for one formed alike, else 0."""
        score = 1.0
        for part in word.split("-"):
            f = fold(part)
            if f in self.family:
                continue
            if any(f[:k] in self.stems and f[k:] in self.endings for k in range(2, len(f) - 2)):
                score = min(score, 0.8)
            else:
                return 0.0
        return score

    def given_score(self, word: str) -> float:
        """1 for a known given name, 0.3 for another capitalised word that may be one, else 0."""
        f = fold(word)
        if f in self.given or all(p in self.given for p in f.split("-")):
            return 1.0
        return 0.0 if f in NO_GIVEN or len(f) < 2 or word.endswith(("'s", "’s")) else 0.3


def luhn(digits: str) -> bool:
    """The check digit of payment cards."""
    total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of bank account numbers: 1 modulo 97 after moving the first four characters last."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def mod11_10(digits: str) -> bool:
    """The check digit of 11-digit tax numbers (hybrid system modulo 11, 10)."""
    product = 10
    for d in digits[:-1]:
        product = ((int(d) + product) % 10 or 10) * 2 % 11
    return (11 - product) % 10 == int(digits[-1])


Span = tuple[int, int, str, float]


def emails(text: str) -> Iterator[Span]:
    """Addresses, also with spaces or words for the signs; none of repositories, packages or machines."""
    for m in EMAIL_AT.finditer(text):
        left = EMAIL_LOCAL.search(text[max(0, m.start() - 80) : m.start()])
        right = EMAIL_DOMAIN.match(text, m.end())
        if not left or not right or len(right[1]) != len(left[2]):
            continue
        begin, end = m.start() - len(left[0]), right.end()
        score = 0.9
        if left[1].lower() == "git" or re.match(r":[\w~/.]", text[end : end + 2]) or text[max(0, begin - 3) : begin].endswith("://"):
            score = 0.1
        yield begin, end, "email", score


def phones(text: str) -> Iterator[Span]:
    """Numbers with country code and extension as written; 7 to 15 digits without the extension."""
    for m in PHONE.finditer(text):
        plain = re.split(r"(?i)x|ext", m[0])[0]
        digits = re.sub(r"\D", "", plain)
        if not 9 <= len(digits) <= 16:
            continue
        before = text[max(0, m.start() - 40) : m.start()]
        score = 0.3 if m[1] == " " else 0.6  # ten digits in plain groups need a word that speaks for a phone
        if PHONE_WORDS.search(before):
            score += 0.3
        if ID_WORDS.search(before) or NOT_ID_WORDS.search(before):
            score -= 0.5
        yield m.start(), m.end(), "phone", score


def id_numbers(text: str) -> Iterator[Span]:
    """Identity numbers without their label; shapes that machines also use need a label or a checksum."""
    for m in ID_NUMBER.finditer(text):
        kind = next(k for k, v in m.groupdict().items() if v)
        before = text[max(0, m.start() - 45) : m.start()]
        labelled = bool(ID_WORDS.search(before))
        bare = re.sub(r"[ -]", "", m[0])
        score = {"ssn": 0.5, "nino": 0.55, "card2": 0.3, "tax": 0.1, "passport": 0.1}.get(kind, 0.0)
        if kind == "ssn" and (bare.startswith("000") or bare[3:5] == "00" or bare.endswith("0000")):
            continue  # never given out
        if kind == "ssn" and m[0][3] == " ":
            score = 0.3
        if kind == "tax" and mod11_10(bare):
            score += 0.3
        if kind == "iban":
            score = 0.9 if mod97(bare) else 0.0
        if kind == "pan":
            known = CARD_ISSUER.match(bare) and len(bare) <= 19 and luhn(bare)
            score = (0.7 if m[0] != bare else 0.55) * bool(known) + 0.2 * bool(known and CARD_WORDS.search(before))
        if labelled:
            score += 0.45 if sum(map(str.isdigit, bare)) >= 5 else 0.0
            if kind == "other":
                score += 0.1 * (sum(map(str.isdigit, bare)) >= 6)
        elif NOT_ID_WORDS.search(before):
            score -= 0.4
        yield m.start(), m.end(), "id_number", score
    for m in IBAN_LOWER.finditer(text):
        if mod97(m[0].replace(" ", "").upper()):
            yield m.start(), m.end(), "id_number", 0.8


def addresses(text: str) -> Iterator[Span]:
    """From house number or street to town or postcode."""
    for m in ADDRESS.finditer(text):
        before = text[max(0, m.start() - 40) : m.start()]
        score = 0.5 + 0.2 * bool(m["town"] or m["town2"] or m["town3"]) + 0.3 * bool(m["code"] or m["code2"] or m["code3"])
        if ADDRESS_WORDS.search(before):
            score += 0.2
        elif NO_ADDRESS_WORDS.search(before):
            score -= 0.3
        yield m.start(), m.end(), "address", score


def names(text: str, known: Names) -> Iterator[Span]:
    """Given and family name together, in either order, with initials and particles."""
    at = 0
    while m := NAME.search(text, at):
        first, comma, initials, particles, last = m.groups()
        at, own = m.start(5), 2 * last.endswith(("'s", "’s"))  # a possessive ending is no part of the name
        last = last[: len(last) - own]
        if comma:
            if initials or particles:
                continue
            f, g = known.family_score(first), known.given_score(last)
            tail = re.compile(r" [A-Z]\.(?=\s|[,;\"')<]|$)").match(text, m.end())
            begin, end = m.start(), m.end()
            if tail and g == 1.0 and not re.match(r" [A-Z]", text[tail.end() : tail.end() + 2]):
                end = tail.end()
        else:
            f, g = known.family_score(last), known.given_score(first)
            begin, end = m.start(), m.end() - own
            if f == 0.0 and "-" in last:
                continue
        if not f and g < 1.0 or not g:
            continue
        score = 0.5 * f + 0.4 * g
        if NAME_CUE.search(text[max(0, begin - 20) : begin]):
            score += 0.2
        if score >= THRESHOLD:
            at = end
        yield begin, end, "name", score


def find(text: str, known: Names) -> list[Span]:
    """The spans of ``text`` that count, in order and without overlap; name parts inside an address of mail are no names."""
    spans: list[Span] = []
    has_digit = any(map(text.__contains__, "0123456789"))
    if "@" in text or "at)" in text.lower() or "at]" in text.lower():
        spans += emails(text)
    if has_digit:
        spans += phones(text)
        spans += id_numbers(text)
        spans += addresses(text)
    spans += names(text, known)
    kept: list[Span] = []
    for s in sorted((s for s in spans if s[3] >= THRESHOLD), key=lambda s: (s[2] != "email", -s[3], s[0] - s[1], s[0])):
        if all(s[1] <= k[0] or k[1] <= s[0] for k in kept):
            kept.append(s)
    return sorted(kept)


def redact(text: str, known: Names, spans: list[Span] | None = None) -> str:
    """``text`` with each span (as found by ``find``) replaced by its type, as ``[EMAIL]``; all else stays as it is."""
    out, at = [], 0
    for begin, end, kind, _ in find(text, known) if spans is None else spans:
        out += [text[at:begin], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def load_names(parts: DataFrame) -> Names:
    """The known name parts (``part_text``, ``part_kind``); nulls are ignored."""
    rows = parts.select("part_text", "part_kind").limit(MOST_NAME_PARTS + 1).collect()
    if len(rows) > MOST_NAME_PARTS:
        raise ValueError(f"more than {MOST_NAME_PARTS} name parts")
    return Names.learn([(r[0], r[1]) for r in rows])


#: One text of an entry: its field (``content`` or ``summary``) and the block of the content, 0 where that is a string.
PLACED = "source_id string, entry_id string, field string, block int"


def _over(entries: DataFrame, parts: DataFrame, schema: str, make: Callable[[tuple, str, Names], Iterator[tuple]]) -> DataFrame:
    known = entries.sparkSession.sparkContext.broadcast(load_names(parts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source, entry, message, summary in zip(batch["source_id"], batch["entry_id"], batch["message"], batch["summary"], strict=True):
                if isinstance(summary, str):
                    rows += make((source, entry, "summary", 0), summary, known.value)
                if isinstance(message, str) and (found := parse(message)) is not None:
                    for block, text in placed_texts(found):
                        rows += make((source, entry, "content", block), text, known.value)
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    columns = [c.split()[0] for c in schema.split(", ")]
    wanted = entries.select("source_id", "entry_id", "message", F.when(F.col("entry_type") == "compaction", F.col("summary")).alias("summary"))
    return wanted.filter("message is not null or summary is not null").mapInPandas(run, schema)


def found(entries: DataFrame, parts: DataFrame) -> DataFrame:
    """Distinct (``source_id``, ``entry_id``, ``pii_type``, ``pii_text``) of all entries.

    Looks at the summary of compaction entries and at the decoded content of
    messages whose JSON can be parsed.  Null, empty and unreadable texts give no
    row; repeated lines and repeated pieces give one row; an empty table gives
    an empty result; other columns are ignored.
    """

    def rows(place: tuple, text: str, known: Names) -> Iterator[tuple]:
        return ((*place[:2], kind, text[a:b]) for a, b, kind, _ in find(text, known))

    return _over(entries, parts, "source_id string, entry_id string, pii_type string, pii_text string", rows).distinct()


def redacted(entries: DataFrame, parts: DataFrame) -> DataFrame:
    """Every text with placeholders: ``PLACED``, ``redacted_text`` and ``replaced``, the number of pieces (0 in a clean text).

    Distinct rows, so repeated lines count once; cases as in ``found``.
    """

    def rows(place: tuple, text: str, known: Names) -> Iterator[tuple]:
        spans = find(text, known)
        yield *place, redact(text, known, spans), len(spans)

    return _over(entries, parts, f"{PLACED}, redacted_text string, replaced long", rows).distinct()


def cleaned(entries: DataFrame, parts: DataFrame) -> DataFrame:
    """The same rows and columns, ``message`` and ``summary`` with placeholders.

    A message is written anew only where something was replaced; what can't be
    parsed stays as it is.
    """
    known = entries.sparkSession.sparkContext.broadcast(load_names(parts))
    kept = [c for c in entries.columns if c not in ("message", "summary")]

    def message(text: object) -> object:
        found = parse(text) if isinstance(text, str) else None
        if found is None:
            return text
        new = {block: redact(t, known.value) for block, t in placed_texts(found)}
        if all(new[block] == t for block, t in placed_texts(found)):
            return text
        if isinstance(found["content"], str):
            found["content"] = new[0]
        else:
            for block, t in new.items():
                if isinstance(found["content"][block], str):
                    found["content"][block] = t
                else:
                    found["content"][block]["text"] = t
        return json.dumps(found, ensure_ascii=False)

    def run(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for kinds, messages, summaries in columns:
            short = [redact(s, known.value) if k == "compaction" and isinstance(s, str) else s for k, s in zip(kinds, summaries, strict=True)]
            yield pd.DataFrame({"message": [message(m) for m in messages], "summary": short}, dtype=object)

    both = F.pandas_udf(run, "message string, summary string", F.PandasUDFType.SCALAR_ITER)
    made = entries.withColumn("_clean", both("entry_type", "message", "summary"))
    return made.select(*(F.col(c) if c in kept else F.col(f"_clean.{c}").alias(c) for c in entries.columns))
