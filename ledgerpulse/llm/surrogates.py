"""Surrogates for personal data: keyed replacements that keep kind, gender, script and format.

Found entities are reduced to distinct (kind, value) pairs over all documents.
Each gets candidates from a keyed hash until its surrogate is neither that of
another entity nor an entity of the corpus, so distinct entities stay distinct
and every mention of one entity, in any document, gets the same surrogate.
Names are replaced part by part, so a full name and a later bare part agree.
Without the key the replacement cannot be recomputed.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerpulse.llm.frames import TEXTS_AT_ONCE, unused
from ledgerpulse.session import stage

#: From this attempt on a candidate may be longer than its entity, so that a full format never blocks.
WIDER = 6

EMAIL = re.compile(r"(?<![\w.+-])([\w+-]+(?:\.[\w+-]+)*)@((?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,})(?![\w-])")
PHONE = re.compile(
    r"(?<![\w.+])(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}([ .-])\d{3}\1\d{4}"
    # national numbers: French, German, Spanish
    r"|0[1-9](?:[ .-]?\d{2}){4}|\(?0[1-9]\d{1,4}\)?(?: ?/ ?| ?- ?| )\d{3,8}(?:[ -]\d{1,8}){0,3}|[6-9]\d{2}(?:(?:[ -]\d{3}){2}|(?:[ -]\d{2}){3}))(?!\w|[.-]\d)"
)
CARD = re.compile(r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w]|[.-]\d)")
IPV4 = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
SSN = re.compile(r"(?<![\w-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")

# Forms of address with the gender they tell (m, f, or x for either).
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f",
    "Sra": "f", "Señorita": "f", "Doña": "f", "Dr": "x", "Prof": "x", "Господин": "m", "Госпожа": "f", "г-н": "m", "г-жа": "f",
    "Κύριος": "m", "Κυρία": "f",
}
#: Titles that are common words in lower case; these count only with a capital.
ALSO_WORDS = {"Miss", "Don", "Sir", "Madam"}
#: The gender by every spelling of a title: as listed, in capitals and, unless it is a common word then, in lower case.
GENDERS = {form: gender for title, gender in TITLES.items() for form in (title, title.upper(), title if title in ALSO_WORDS else title.lower())}
NAME = re.compile(rf"(?<!\w)({'|'.join(sorted(GENDERS, key=len, reverse=True))})(\.? )(?=([^\W\d_]+(?:[-'’][^\W\d_]+)*(?: [^\W\d_]+(?:[-'’][^\W\d_]+)*){{0,2}}))")
#: A word, and the sign between the words of a compound name.
WORD = re.compile(r"\w+")
JOINTS = "-'’"

# Syllables from which names are built, by script, and endings by gender.
SYLLABLES = {
    "LATIN": "ba be bo ca ce co da de do fa fe ga go ha he ja jo ka ke la le lo ma me mo na ne no pa pe ra re ro sa se ta te to va ve vi wa za".split(),
    "CYRILLIC": "ба бе бо ва ве во га го да де до за зе ка ко ла ле ло ма ме мо на не но па пе ра ре ро са се та те то фа ха".split(),
    "GREEK": "βα βε βο γα γε δα δε δο ζα θα θε κα κε κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε τα τε το φα".split(),
}
ENDINGS = {
    "LATIN": {"m": "n", "f": "a", "x": "s"},
    "CYRILLIC": {"m": "н", "f": "я", "x": "к"},
    "GREEK": {"m": "ς", "f": "α", "x": "ι"},
}


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        value = int(c) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def iban_valid(value: str) -> bool:
    text = value.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _card(value: str) -> bool:
    digits = re.sub(r"\D", "", value)
    return 13 <= len(digits) <= 19 and digits[0] in "23456" and luhn(digits)


def _ipv6(value: str) -> str | None:
    """The address in its shortest form; None for what is none, or has a single group (::1) or no digit."""
    if len(re.findall("[0-9A-Fa-f]+", value)) < 2 or not any(c in "0123456789" for c in value):
        return None
    try:
        return ipaddress.IPv6Address(value).compressed
    except ValueError:
        return None


def _plain(value: str) -> str:
    return re.sub(r"[\W_]", "", value)


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the personal data in a text, in order and without overlaps.

    The value is what mentions of one entity have in common: digits without
    punctuation, lower-cased addresses. Kinds: email, card, iban, ssn, phone,
    ip, ip6 and, after a form of address, given_m, given_f, given_x and surname; a
    capitalised part of such a name is an entity wherever it stands in the text
    with a capital. In lower case it is one only if the text has it more often
    with a capital, and not in lower case before the name is told: "brown bread"
    stays as it is beside "Mr Brown". After a title in capitals ("MR SMITH"),
    where any word may follow in capitals, the name is replaced there alone.
    A null or empty text has none.
    """
    if not text:
        return []
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(*m.span(), "email", m[0].lower()) for m in EMAIL.finditer(text)]
    if any(c in text for c in "0123456789"):
        found += [(*m.span(), "iban", _plain(m[0])) for m in IBAN.finditer(text) if iban_valid(m[0])]
        found += [(*m.span(), "card", _plain(m[0])) for m in CARD.finditer(text) if _card(m[0])]
        found += [(*m.span(), "ssn", _plain(m[0])) for m in SSN.finditer(text)]
        found += [(*m.span(), "phone", _plain(m[0])) for m in PHONE.finditer(text) if 7 <= len(_plain(m[0])) <= 15]
        found += [(*m.span(), "ip", m[0]) for m in IPV4.finditer(text)]
        found += [(*m.span(), "ip6", value) for m in IPV6.finditer(text) if (value := _ipv6(m[0]))]
    found += _names(text)
    out: list[tuple[int, int, str, str]] = []
    for e in sorted(found, key=lambda e: (e[0], -e[1])):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def _names(text: str) -> list[tuple[int, int, str, str]]:
    """The names told by titles and their other mentions, by one pass over the words of the text."""
    found, parts, told, sizes = [], {}, {}, set()
    for m in NAME.finditer(text):
        at, name = m.start(3), []
        for part in m[3].split(" "):
            if not part[0].isupper() or len(part) < 2 or name and part in GENDERS:
                break
            name.append((at, part))
            at += len(part) + 1
        for k, (at, part) in enumerate(name):
            kind = "surname" if k == len(name) - 1 else f"given_{GENDERS[m[1]]}"
            if len(m[1]) > 1 and m[1].isupper():
                found.append((at, at + len(part), kind, part.lower()))
            else:
                # letters with several lower-case forms meet in the folded text
                folded = part.casefold()
                parts.setdefault(folded, (kind, part.lower()))
                told.setdefault(folded, at)
                sizes.add(len(WORD.findall(part)))
    if not parts:
        return found
    mentions: dict[str, list[tuple[int, int]]] = {}
    lowers: dict[str, list[tuple[int, int]]] = {}
    longest = max(sizes)
    run: list[tuple[int, int]] = []

    def close() -> None:
        # a run of words joined by signs: at each word the longest name that starts there
        i = 0
        while i < len(run):
            step = 1
            for size in sorted(sizes, reverse=True) if longest > 1 else (1,):
                if i + size <= len(run):
                    start, stop = run[i][0], run[i + size - 1][1]
                    folded = text[start:stop].casefold()
                    if folded in parts:
                        (mentions if text[start].isupper() else lowers).setdefault(folded, []).append((start, stop))
                        step = size
                        break
            i += step
        run.clear()

    for m in WORD.finditer(text):
        if run and not (m.start() == run[-1][1] + 1 and text[run[-1][1]] in JOINTS):
            close()
        run.append(m.span())
    close()
    for folded, (kind, value) in parts.items():
        upper, lower = mentions.get(folded, []), lowers.get(folded, [])
        if len(lower) < len(upper) and not (lower and lower[0][0] < told[folded]):
            upper = upper + lower
        found += [(*span, kind, value) for span in upper]
    return found


class _Stream:
    """Numbers below a bound, drawn from a keyed hash of what names the draw."""

    def __init__(self, key: bytes, *name: object):
        self.key, self.name, self.block, self.pool, self.left = key, "|".join(map(str, name)), 0, 0, 1

    def below(self, n: int) -> int:
        if self.left < n << 64:
            digest = hmac.new(self.key, f"{self.name}|{self.block}".encode(), hashlib.sha256).digest()
            self.pool, self.left, self.block = int.from_bytes(digest, "big"), 1 << 256, self.block + 1
        value = self.pool % n
        self.pool, self.left = self.pool // n, self.left // n
        return value


def _digits(draw: _Stream, n: int, first: str = "0123456789") -> str:
    return "".join((first if i == 0 else "0123456789")[draw.below(len(first) if i == 0 else 10)] for i in range(n))


def _script(text: str) -> str:
    for c in text:
        name = unicodedata.name(c, "").split(" ")[0]
        if name in SYLLABLES:
            return name
    return "LATIN"


def _word(draw: _Stream, length: int, script: str, ending: str = "") -> str:
    out = ""
    while len(out) < length - len(ending):
        out += SYLLABLES[script][draw.below(len(SYLLABLES[script]))]
    return out[: max(1, length - len(ending))] + ending


def _like(draw: _Stream, text: str, extra: int) -> str:
    """Letters for letters of the script, digits for digits, all else as it is."""
    def run(m: re.Match) -> str:
        if m[0][0].isdigit():
            return _digits(draw, len(m[0]) + extra, "123456789")
        return _word(draw, max(3, len(m[0])) + 2 * extra, _script(m[0]))

    return re.sub(r"\d+|[^\W\d_]+", run, text)


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """The candidate value of an entity: of the same kind, and valid where the kind has a check."""
    draw, extra = _Stream(key, kind, value, attempt), max(0, attempt - WIDER + 1)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        # the domain is keyed by itself, so that one organisation stays one; reserved and top names are kept
        keep = 2 if len(labels) > 2 and labels[-2] in ("example", "co", "com", "ac", "org") else 1
        own = _Stream(key, "domain", domain)
        labels[:-keep] = [_like(own, label, 0) for label in labels[:-keep]]
        return f"{_like(draw, local, extra)}@{'.'.join(labels)}"
    if kind == "card":
        body = value[0] + _digits(draw, len(value) - 2 + extra)
        return body + next(c for c in "0123456789" if luhn(body + c))
    if kind == "iban":
        body = "".join(_digits(draw, 1) if c.isdigit() else chr(65 + draw.below(26)) for c in value[4:]) + _digits(draw, extra)
        check = 98 - int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        return f"{value[:2]}{check:02d}{body}"
    if kind == "ssn":
        return f"{1 + draw.below(665):03d}{1 + draw.below(99):02d}{1 + draw.below(9999):04d}" + _digits(draw, extra)
    if kind == "phone":
        country = len(value) - 10 if len(value) > 10 else 0
        if value[0] == "0":  # a national number keeps its sort
            country = max(country, 2)
        elif len(value) == 9:
            country = 1
        rest = len(value) - country + extra
        body = _digits(draw, min(3, rest), "23456789") + _digits(draw, max(0, rest - 3), "23456789")
        if rest == 10 and value[country + 3 : country + 6] == "555":  # numbers set aside for examples stay such
            body = body[:3] + "555" + body[6:]
        return value[:country] + body
    if kind == "ip":
        a, b, *_ = map(int, value.split("."))
        head = [str(a), str(b)] if (a, b) == (192, 168) else [str(a)] if a in (10, 127) else [str(a), str(16 + draw.below(16))] if a == 172 and 16 <= b < 32 else []
        if not head:
            first = [n for n in range(1, 224) if n not in (10, 127, 169, 172, 192, 198, 203)]
            head = [str(first[draw.below(len(first))])]
        tail = [str(draw.below(254) + 1) for _ in range(4 - len(head))]
        return ".".join(head + tail) + "".join(f".{draw.below(255)}" for _ in range(extra))
    if kind == "ip6":
        first, sign, rest = value.partition(":")
        group = lambda m: "123456789abcdef"[draw.below(15)] + "".join("0123456789abcdef"[draw.below(16)] for _ in range(min(4, len(m[0]) + extra) - 1))
        return first + sign + re.sub("[0-9a-f]+", group, rest)
    script = _script(value)
    gender = kind[-1] if kind.startswith("given") else "x"
    return _word(draw, 4 + 2 * draw.below(3) + 2 * extra, script, ENDINGS[script][gender])


def dressed(kind: str, value: str, mention: str) -> str:
    """A surrogate value in the format of a mention: its punctuation and its case."""
    if kind in ("card", "iban", "ssn", "phone"):
        digits, out = iter(value), []
        for c in mention:
            out.append(next(digits, "") if c.isalnum() else c)
        return "".join(out) + "".join(digits)
    if mention.isupper() and any(c.isalpha() for c in mention):
        return value.upper()
    return value.title() if kind not in ("email", "ip", "ip6") and mention[0].isupper() else value


_SPANS = "array<struct<start: int, stop: int, kind: string, value: string>>"


def find_entities(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with an array column ``name`` of start, stop (in code points), kind and value."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fields = ("start", "stop", "kind", "value")
        for texts in batches:
            yield pd.Series([[dict(zip(fields, e, strict=True)) for e in entities(t)] for t in texts], dtype="object")

    return docs.withColumn(name, F.pandas_udf(run, _SPANS).asNondeterministic()(F.col("text")))


def assign(known: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for the distinct entities (kind, value) of ``known``.

    Rounds: every entity without a surrogate takes its next candidate; of those
    with the same candidate the first keeps it, unless it is an entity of
    ``known`` or taken before. Surrogates of one kind are distinct, given names
    and surnames counting as one kind.
    """
    secret = key.encode()

    def candidates(attempt: int):
        def run(kinds: pd.Series, values: pd.Series) -> pd.Series:
            return pd.Series([surrogate(k, v, secret, attempt) for k, v in zip(kinds, values, strict=True)], dtype="object")

        return F.pandas_udf(run, "string").asNondeterministic()

    family = F.when(F.col("kind").rlike("^(given|surname)"), "name").otherwise(F.col("kind"))
    known = stage(known.withColumn("family", family), "entities")
    real = known.select("family", F.col("value").alias("surrogate"))
    waiting, accepted, attempt = known, None, 0
    while True:
        offered = stage(waiting.withColumn("surrogate", candidates(attempt)("kind", "value")), f"offer{attempt}")
        free = offered.join(real, ["family", "surrogate"], "left_anti")
        if accepted is not None:
            free = free.join(accepted.select("family", "surrogate"), ["family", "surrogate"], "left_anti")
        won = free.groupBy("family", "surrogate").agg(F.min(F.struct("kind", "value")).alias("first"))
        won = stage(won.select("family", "first.kind", "first.value", "surrogate"), f"taken{attempt}")
        accepted = won if accepted is None else accepted.unionByName(won)
        waiting = stage(offered.drop("surrogate").join(won.select("kind", "value"), ["kind", "value"], "left_anti"), f"left{attempt}")
        if waiting.isEmpty():
            return accepted.drop("family")
        attempt += 1


def settled_kinds(known: DataFrame) -> DataFrame:
    """(kind, value, settled) of the distinct entities (kind, value): a name has one kind in all documents.

    A given name has the gender that titles tell, x if they tell both or none; a surname that is also a given name is one.
    """
    has = lambda kind: F.max(F.col("kind") == kind)
    names = known.where(F.col("kind").rlike("^(given|surname)")).groupBy("value").agg(
        F.when(has("given_m") & has("given_f"), "given_x").when(has("given_m"), "given_m").when(has("given_f"), "given_f")
        .when(has("given_x"), "given_x").otherwise("surname").alias("settled"),
        F.collect_set("kind").alias("kinds"),
    )
    others = known.where(~F.col("kind").rlike("^(given|surname)")).select("kind", "value", F.col("kind").alias("settled"))
    return others.unionByName(names.select(F.explode("kinds").alias("kind"), "value", "settled"))


def replace_personal_data(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in the text, beside an array column ``surrogates`` (start, stop, kind, surrogate) of what was replaced.

    A null text stays null. Texts without personal data are passed on as they
    are, without a shuffle; the others meet their replacements by a digest of
    the text, which identical copies share. A column named ``surrogates`` is replaced.
    Repeated rows are all returned, and an empty table gives an empty one.
    """
    docs = docs.drop("surrogates")
    spans, digest, other = unused(docs, "entity_spans", "text_digest", "other_digest")
    found = find_entities(docs, spans)
    with_digest = F.md5(F.col("text").cast("binary"))
    mentions = stage(
        found.where(F.size(spans) > 0).select(with_digest.alias(digest), F.explode(spans).alias("e")).select(digest, "e.*").distinct(), "mentions", TEXTS_AT_ONCE
    )
    kinds = stage(settled_kinds(mentions.select("kind", "value").distinct()), "kinds")
    drawn = assign(kinds.select(F.col("settled").alias("kind"), "value").distinct(), key).withColumnRenamed("kind", "settled")
    table = stage(kinds.join(drawn, ["settled", "value"]), "surrogates")
    mapped = mentions.join(table, ["kind", "value"]).drop("kind").withColumnRenamed("settled", "kind")
    per_text = mapped.groupBy(F.col(digest).alias(other)).agg(
        F.array_sort(F.collect_list(F.struct("start", "stop", "kind", "surrogate"))).alias("surrogates")
    )
    per_text = stage(per_text, "replacements")

    @F.pandas_udf("text string, surrogates array<struct<start: int, stop: int, kind: string, surrogate: string>>")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, replaced in batches:
            yield pd.DataFrame([_applied(t, r) for t, r in zip(texts, replaced, strict=True)], columns=["text", "surrogates"])

    touched = found.where(F.size(spans) > 0).drop(spans).withColumn(digest, with_digest)
    # a broadcast would put both functions into one task, which takes two Python workers; idle ones keep their memory
    touched = touched.join(per_text.hint("merge"), F.col(digest) == F.col(other)).drop(digest, other)
    (new,) = unused(touched, "replaced")
    touched = touched.withColumn(new, apply("text", "surrogates"))
    clean = found.where(F.size(spans) == 0).select(*docs.columns, F.array().cast(_SPANS.replace("value", "surrogate")).alias("surrogates"))
    columns = [F.col(f"{new}.text").alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return clean.unionByName(touched.select(*columns, F.col(f"{new}.surrogates").alias("surrogates")))


def _applied(text: str, spans) -> tuple[str, list[dict]]:
    out, at, done = [], 0, []
    for s in spans:
        new = dressed(s["kind"], s["surrogate"], text[s["start"] : s["stop"]])
        out += [text[at : s["start"]], new]
        at = s["stop"]
        done.append({"start": s["start"], "stop": s["stop"], "kind": s["kind"], "surrogate": new})
    return "".join([*out, text[at:]]), done


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with personal data replaced; n_chars, if there is one, is counted anew where the text has changed.

    A null text stays null, repeated rows get one replacement, an empty table gives an empty one.
    """
    replaced = replace_personal_data(docs, key)
    if "n_chars" in docs.columns:
        counted = F.when(F.size("surrogates") > 0, F.length("text")).otherwise(F.col("n_chars"))
        replaced = replaced.withColumn("n_chars", counted.cast(docs.schema["n_chars"].dataType))
    return replaced.select(*docs.columns)
