"""PII: detected entities get keyed surrogates of their own type and format.

Detected: e-mail addresses, telephone numbers, IPv4 addresses, payment card numbers with a valid check
digit, secrets after words such as ``token =``, and personal names (a title or a known first name, then a
capitalised word). A surrogate comes from a keyed permutation of all values of the same format: letters
stay letters of their script and case, digits stay digits, marks stay; card check digits are made valid.
A permutation gives equal values equal surrogates everywhere and different values different ones. First
names go to first names of the same gender and script; a name that titles of the corpus give one gender has it
wherever it stands, one that they give both has none, so every value has one surrogate. As those lists are short
and e.g. a value may meet its own surrogate, every distinct (value, surrogate) pair of the corpus is checked: where
two values of a type share a surrogate, or a surrogate is a value that really occurs, all but the smallest value
draw again until none collide.

Null texts stay null, empty ones empty. Documents without entities keep their bytes. Repeated rows get
equal results. Extra columns are kept as they are; ``pii_types`` and ``pii_count`` are written anew.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: First names by script and gender.
FIRST_NAMES = {
    ("latin", "f"): ("Alice", "Amelia", "Anna", "Carmen", "Charlotte", "Clara", "Elena", "Emma", "Hannah", "Ingrid", "Julia", "Laura", "Lucia", "Maria", "Marie", "Nora", "Olivia", "Paula", "Sarah", "Sofia"),
    ("latin", "m"): ("Adam", "Antonio", "Carlos", "Daniel", "David", "Felix", "George", "Hugo", "Jack", "James", "Jean", "John", "Louis", "Lukas", "Martin", "Michael", "Paul", "Pedro", "Peter", "Thomas"),
    ("cyrillic", "f"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана"),
    ("cyrillic", "m"): ("Алексей", "Борис", "Виктор", "Дмитрий", "Иван", "Михаил", "Николай", "Сергей"),
    ("greek", "f"): ("Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"),
    ("greek", "m"): ("Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος"),
}
#: Titles, and the gender they tell.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Monsieur": "m", "Madame": "f", "Mme": "f"}
#: Letters that may replace each other, each its own upper case beside it.
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "àâäçèéêëîïñóôöùûüáíú", "абвгдежзиклмнопрстуфхцчшщэюя", "αβγδεζηθικλμνξοπρστυφχψω", "άέήίόύώ")

#: Draws of a name that leave its surname's surrogate alone.
SURNAME_DRAWS = 8
#: Values with a draw of their own that every worker gets; beyond, documents get theirs by a join.
SENT_VALUES = 100_000

_NAMES = {n: key for key, names in FIRST_NAMES.items() for n in names}
_CAP = r"[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω][\w’'-]+"
PATTERNS = (
    ("secret", re.compile(r"(?i:\b(?:token|api[_-]?key|secret|password|passwd)\b)\s*[=:]\s*[\"']?(?P<v>[A-Za-z0-9_\-/+]{12,})")),
    ("email", re.compile(r"(?<![\w.+-])(?P<v>[\w.+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})")),
    ("ip", re.compile(r"(?<![\d.])(?P<v>(?:\d{1,3}\.){3}\d{1,3})(?![\d]|\.\d)")),
    ("card", re.compile(r"(?<![\d])(?P<v>\d(?:[ -]?\d){12,18})(?![\d])")),
    ("phone", re.compile(r"(?<![\w+])(?P<v>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}[ .-]\d{4})(?!\d)")),
    ("name", re.compile(rf"\b(?:(?P<title>{'|'.join(TITLES)})\.? (?P<v>{_CAP}(?: {_CAP})?)|(?P<w>(?:{'|'.join(_NAMES)}) {_CAP}))")),
)
#: What a text must have for a pattern to be tried.
_HAS_DIGITS = re.compile(r"\d[\d. ()-]{5}")
_HAS_SECRET = re.compile(r"(?i)token|key|secret|passw")
_HAS_NAME = re.compile(rf"\b(?:{'|'.join(TITLES)})\.? |\b(?:{'|'.join(_NAMES)}) ")


def card_valid(value: str) -> bool:
    d = [int(c) for c in value if c.isdigit()][::-1]
    return 13 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, detail) without overlaps; an earlier type of PATTERNS wins. detail: a title's gender."""
    found: list[tuple[int, int, str, str]] = []
    digits = bool(_HAS_DIGITS.search(text))
    able = {"secret": bool(_HAS_SECRET.search(text)), "email": "@" in text, "ip": digits, "card": digits, "phone": digits, "name": bool(_HAS_NAME.search(text))}
    for kind, pattern in PATTERNS:
        if not able[kind]:
            continue
        for m in pattern.finditer(text):
            name = "v" if m.group("v") is not None else "w"
            a, z = m.span(name)
            value = m.group(name)
            if kind == "card" and not card_valid(value) or kind == "ip" and any(int(x) > 255 for x in value.split(".")):
                continue
            if any(a < q and p < z for p, q, _, _ in found):
                continue
            found.append((a, z, kind, TITLES.get(m.group("title") or "", "") if kind == "name" else ""))
    return sorted(found)


def normal(kind: str, value: str) -> str:
    """The form under which values of a type are the same one."""
    if kind == "email":
        return value.lower()
    if kind in ("card", "phone"):
        return re.sub(r"[^\d+]", "", value)
    return value


def permuted(key: bytes, label: str, number: int, size: int) -> int:
    """A keyed permutation of range(size): a Feistel network over two halves, walked until inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = number >> half, number & mask
        for r in range(6):
            f = hmac.digest(key, f"{label}|{size}|{r}|{b}".encode(), "sha256")
            a, b = b, a ^ (int.from_bytes(f * (half // 256 + 1), "big") & mask)
        number = a << half | b
        if number < size:
            return number


def same_format(key: bytes, label: str, value: str, fixed: set[int] = frozenset()) -> str:
    """Permute the letters and digits of a value among all values of its format; places in ``fixed`` stay."""
    places, number, size, shape = [], 0, 1, []
    for k, c in enumerate(value):
        if k in fixed:
            shape.append(c)
            continue
        low = c.lower()
        alphabet = "0123456789" if "0" <= c <= "9" else next((x for x in ALPHABETS if low in x), "")
        if alphabet:
            places.append((k, alphabet, c != low))
            number = number * len(alphabet) + alphabet.index(low)
            size *= len(alphabet)
            shape.append(f"<{len(alphabet)}{'u' if c != low else ''}>")
        else:
            shape.append(c)
    out = list(value)
    if size > 1:
        number = permuted(key, label + "".join(shape), number, size)
    for k, alphabet, upper in reversed(places):
        number, d = divmod(number, len(alphabet))
        out[k] = alphabet[d].upper() if upper else alphabet[d]
    taken = {k for k, _, _ in places} | fixed
    for k, c in enumerate(value):
        if c.isalpha() and k not in taken:  # no permutation holds it; the check of collisions keeps values apart
            letter = ALPHABETS[0][hmac.digest(key, f"{label}{value}|{k}".encode(), "sha256")[0] % 26]
            out[k] = letter.upper() if c.isupper() else letter
    return "".join(out)


def _script(word: str) -> str:
    c = word[:1]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def surrogate(key: bytes, kind: str, value: str, detail: str = "", attempt: int = 0) -> str:
    """The replacement of a normal value; another attempt gives another one."""
    label = f"{kind}#{attempt}|"
    if kind == "email":
        local, _, domain = value.rpartition("@")
        top = domain.rpartition(".")[2]
        made = same_format(key, label, f"{local}@{domain}", set(range(len(value) - len(top), len(value))))
        return made
    if kind == "phone":
        country = len(re.match(r"\+?1?", value).group()) if value.startswith("+1") else 3 if value.startswith("+") else 0
        return same_format(key, label, value, set(range(country)))
    if kind == "card":
        body = same_format(key, label, value[:-1], {0})
        return next(body + d for d in "0123456789" if card_valid(body + d))
    if kind == "ip":
        octets = [int(x) for x in value.split(".")]
        keep = 3 if octets[0] == 10 else 2 if octets[:2] == [192, 168] else 4
        kept, n = octets[: 4 - keep], 0
        for x in octets[4 - keep :]:
            n = n << 8 | x
        while True:
            n = permuted(key, label + ".".join(map(str, kept)), n, 1 << 8 * keep)
            out = kept + [n >> 8 * k & 255 for k in reversed(range(keep))]
            if keep < 4 or 0 < out[0] < 224 and out[0] not in (10, 127) and out[:2] != [192, 168]:
                return ".".join(map(str, out))
    if kind == "name":
        out = []
        words = value.split(" ")
        for k, w in enumerate(words):
            known = _NAMES.get(w)
            if k == 0 and (known or len(words) > 1):
                script, gender = known or (_script(w), detail)
                names = FIRST_NAMES[script, gender] if gender else tuple(n for (s, _), x in FIRST_NAMES.items() if s == script for n in x)
                at = names.index(w) if w in names else int.from_bytes(hmac.digest(key, (label + w).encode(), "sha256")[:8], "big") % len(names)
                out.append(names[permuted(key, f"{label}{script}{gender}", at, len(names))])
            else:
                draw = attempt if len(words) == 1 else max(0, attempt - SURNAME_DRAWS)
                out.append(same_format(key, f"name#{draw}|surname", w))
        return " ".join(out)
    if re.fullmatch("[0-9a-f]+", value):
        return f"{permuted(key, label + str(len(value)), int(value, 16), 16 ** len(value)):0{len(value)}x}"
    return same_format(key, label, value)


def fitted(kind: str, value: str, new: str) -> str:
    """The surrogate in the spelling of an occurrence: its marks and case."""
    if kind in ("card", "phone"):
        digits = iter(c for c in new if c.isdigit())
        return "".join(next(digits, "") if c.isdigit() else c for c in value)
    if kind == "email":
        return "".join(n.upper() if c.isupper() else n for c, n in zip(value, new, strict=True)) if len(value) == len(new) else new
    return new


def pseudonymise(text: str, key: bytes, drawn: dict[tuple[str, str], tuple[str, int]] | None = None) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (type, normal value, surrogate) of each occurrence. drawn: detail and attempt
    of values for which those of the occurrence don't hold."""
    out, done, seen = [], 0, []
    for a, z, kind, detail in find(text):
        value = text[a:z]
        n = normal(kind, value)
        new = surrogate(key, kind, n, *(drawn or {}).get((kind, n), (detail, 0)))
        seen.append((kind, n, new))
        out += (text[done:a], fitted(kind, value, new))
        done = z
    return ("".join(out) + text[done:] if out else text), seen


def _collisions(pairs: DataFrame) -> DataFrame:
    """(kind, value) that must draw again, of the distinct pairs (kind, value, made)."""
    shared_ = pairs.groupBy("kind", "made").agg(F.min("value").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = pairs.join(shared_.hint("merge"), ["kind", "made"]).where("value <> first").select("kind", "value")
    real = pairs.join(pairs.select("kind", F.col("value").alias("made")).distinct().hint("merge"), ["kind", "made"], "left_semi").select("kind", "value")
    return later.unionAll(real).distinct()


def replace_pii(df: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", most_rounds: int = 20) -> DataFrame:
    """The table with surrogates in the text column, and the columns ``pii_types`` and ``pii_count``.

    Entities, not texts, are shuffled: distinct values of the whole corpus are checked against each
    other, and values that had to draw again go to every worker. Where they are more than SENT_VALUES, documents
    get theirs by a join on the text's hash, which shuffles texts; copies of one text are split as skew.
    """
    spark = df.sparkSession
    shared.short_batches(spark)
    texts = df.select(df[text_col].alias("text"))

    def entities(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = {e for t in shared.plain(b.column(0)).to_pylist() for e in _with_detail(t)}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["kind", "value", "detail"])

    # one detail a value: the only gender that its titles tell, else none; mixed: some occurrence tells another one
    told = F.when(F.col("detail") != "", F.col("detail"))
    found = texts.mapInArrow(entities, "kind string, value string, detail string").groupBy("kind", "value")
    found = found.agg(F.min(told).alias("x"), F.max(told).alias("y"), (F.min("detail") != F.max("detail")).alias("mixed"))
    found = found.select("kind", "value", F.when(F.col("x") == F.col("y"), F.col("x")).otherwise("").alias("detail"), F.lit(0).alias("attempt"), "mixed")

    def again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, value, detail, attempt = (b.column(k).to_pylist() for k in range(4))
            made = [surrogate(key, *x) for x in zip(kind, value, detail, attempt, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], ["kind", "value", "detail", "attempt", "mixed", "made"])

    schema = "kind string, value string, detail string, attempt int, mixed boolean, made string"
    values = shared.saved(found.mapInArrow(again, schema))

    for _ in range(most_rounds):
        clash = shared.saved(_collisions(values.select("kind", "value", "made")))
        if clash.isEmpty():
            break
        redrawn = values.join(clash, ["kind", "value"], "left_semi").select("kind", "value", "detail", (F.col("attempt") + 1).alias("attempt"), "mixed").mapInArrow(again, schema)
        values = shared.saved(values.join(clash, ["kind", "value"], "left_anti").unionByName(redrawn))
    else:
        raise RuntimeError("surrogates still collide")
    return _rewritten(df, values.where("attempt > 0 or mixed").select("kind", "value", "detail", "attempt"), key, text_col)


def _with_detail(text: str) -> Iterator[tuple[str, str, str]]:
    """(type, normal value, detail), the detail only where a surrogate rests on it: known first names have their own gender."""
    for a, z, kind, detail in find(text):
        n = normal(kind, text[a:z])
        words = n.split(" ")
        yield kind, n, detail if len(words) > 1 and words[0] not in _NAMES else ""


def _rewritten(df: DataFrame, drawn: DataFrame, key: bytes, text_col: str) -> DataFrame:
    names = [c for c in df.columns if c not in ("pii_types", "pii_count")]
    packed = df.select(F.struct(*[df[f"`{c}`"] for c in names]).alias("row"), df[text_col].alias("text"))

    def occurrences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(h, kind, normal(kind, t[a:z])) for h, t in zip(b.column(0).to_pylist(), shared.plain(b.column(1)).to_pylist(), strict=True) for a, z, kind, _ in find(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], ["h", "kind", "value"])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text")
            out, kinds, counts = [], [], []
            if sent is None:
                drawn_of = [{(x["kind"], x["value"]): (x["detail"], x["attempt"]) for x in d or ()} for d in b.column("drawn").to_pylist()]
            else:
                drawn_of = [sent.value] * len(text)
            for t, d in zip(text.to_pylist(), drawn_of, strict=True):
                new, seen = (None, []) if t is None else pseudonymise(t, key, d)
                out.append(new)
                kinds.append(sorted({k for k, _, _ in seen}))
                counts.append(len(seen))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, pa.string()), pa.array(kinds, pa.list_(pa.string())), pa.array(counts, pa.int64())], ["row", "text", "pii_types", "pii_count"])

    few = drawn.limit(SENT_VALUES + 1).toArrow()
    if few.num_rows <= SENT_VALUES:
        sent = df.sparkSession.sparkContext.broadcast({(r["kind"], r["value"]): (r["detail"], r["attempt"]) for r in few.to_pylist()})
    else:
        sent = None
        slim = df.select(F.xxhash64(df[text_col]).alias("h"), df[text_col].alias("text")).where("text is not null")
        held = slim.mapInArrow(occurrences, "h long, kind string, value string").distinct().join(drawn.hint("merge"), ["kind", "value"]).groupBy("h").agg(F.collect_set(F.struct("kind", "value", "detail", "attempt")).alias("drawn"))
        packed = packed.withColumn("h", F.when(F.col("text").isNotNull(), F.xxhash64("text"))).join(held.hint("merge"), "h", "left").drop("h")
    row = packed.schema["row"].dataType.simpleString()
    out = packed.mapInArrow(write, f"row {row}, text string, pii_types array<string>, pii_count long")
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names], "pii_types", "pii_count")
