"""Problem 8: personal information inside free text.

High-recall generators propose overlapping spans (email, phone, id_number, address,
name); boosted trees, fitted on a bounded sample with labels from strict formats and
the table of given names, score each span by its format and its context; spans above
the calibrated threshold of their kind are kept, and of overlapping ones the best.
Words of a list are features and never take a span out; what endings of names and words
before a span tell, and the thresholds, come from all documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import staged

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

# --- formats ---------------------------------------------------------------------------

_UP, _LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_EMAIL = re.compile(
    r"(?<![\w.+%\-])[\w+%](?:[\w.+%\-]*[\w+%\-])?(?:@|＠|\s?[\[({<]\s?(?:at|arroba|chez)\s?[\])}>]\s?|\s(?:at|AT|arroba)\s(?=\w+(?:\s(?:dot|DOT|punto|point)\s\w+)+))"
    r"\w(?:[\w\-]*\w)?(?:(?:\.|\s?[\[({<]\s?(?:dot|punto|point)\s?[\])}>]\s?|\s(?:dot|DOT|punto|point)\s)\w(?:[\w\-]*\w)?)+",
    re.I,
)
_AT_SPELLED = re.compile(r"[\[({<]\s?(?:at|dot|arroba|punto|point|chez)|\sat\s|\sdot\s", re.I)

# what may not stand directly before or after a number
_B, _E = r"(?<![\w@+])(?<!\d[.\-/,])(?<!\w[.\-_])", r"(?!\w)(?![.\-/,]\d)(?!@)"
_EXT = r"(?:,?\s?(?:ext|x|poste|Durchwahl|anexo)\.?\s?\d{1,5})?"
_PHONES = {
    "intl": r"(?:\(\+\d{1,3}\)|\+\d{1,3}|(?<!\d)00[1-9]\d{0,2})[ .\-/ ]?(?:\(0?\d{0,4}\)[ .\-/]?)?\d(?:[ .\-/ ]?\d){5,11}",
    "nanp": r"(?:1[ .\-]?)?(?:\([2-9]\d{2}\)[ .\-]?|[2-9]\d{2}[ .\-])[2-9]\d{2}[ .\-]\d{4}",
    "nanp_run": r"1?[2-9]\d{2}[2-9]\d{6}",
    "uk": r"(?:\(0[1-9]\d{2,4}\)[ \-]?|0[1-9]\d{2,3}[ \-]|07\d{3}[ \-]?)\d{3}[ \-]?\d{3,4}|0[127]\d{9}",
    "fr": r"0[1-9](?:[ .\-]?\d{2}){4}",
    "de": r"(?:\(0[1-9]\d{1,4}\)[ \-]?|0[1-9]\d{1,4}[ /\-])\d{3,8}(?:[ \-]\d{1,5})?",
    "es": r"[5-9]\d{2}(?:[ .\-]?\d{3}){2}|[5-9]\d{2}(?:[ \-]\d{2}){3}",
    "local": r"[2-9]\d{2}[ .\-]\d{4}",
}
_IDS = {
    "us": r"\d{3}([ \-])\d{2}\1\d{4}",
    "gb": r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]",
    "fr": r"[1-478] ?\d{2} ?\d{2} ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3}(?: ?\d{2})?",
    "de_card": r"[CFGHJKLMNPRTVWXYZ](?=[A-Z\d]{0,3}\d{5})[CFGHJKLMNPRTVWXYZ\d]{8}(?:\d?D)?",
    "de_tax": r"\d{2} \d{3} \d{3} \d{3}",
    "es": r"(?:\d{8}|\d{2}\.\d{3}\.\d{3})[ \-]?[A-Z]",
    "es_foreign": r"[XYZ][ \-]?\d{7}[ \-]?[A-Z]",
}
_PHONE_RES = [(k, re.compile(_B + "(?:" + p + ")" + _EXT + _E)) for k, p in _PHONES.items()]
_PHONE_RES[0] = ("intl", re.compile(r"(?<![\w@+])(?:" + _PHONES["intl"] + ")" + _EXT + _E))
_ID_RES = [(k, re.compile(_B + "(?:" + p + ")" + _E)) for k, p in _IDS.items()]
_NUMBER = re.compile(r"(?<!\w)\+?\(?\d[\d ().\-/]{5,}\d(?!\w)")
_ANY_DIGITS = re.compile(r"\d")
# every phone and identity number holds five digits with at most three other characters between two
_ISLAND = re.compile(r"\d(?:[^\d\n]{0,3}\d){4,}")

_WORD = rf"[{_UP}][\w'’\-]+"
_CITY = rf"(?:,? \d{{4,5}} (?:(?:Bad|El|Fort|La|Las|Le|Los|Mount|New|Port|Saint|San|Sankt|Santa) )?{_WORD})?"
# Words for streets and dwellings in the four languages.
_ADDRESSES = (
    rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room|FLAT|APT\.?) \d+\w?,? )?\d{{1,5}}[A-Za-z]?,? (?:{_WORD} ){{1,3}}"
    r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Boulevard|Blvd|Court|Ct|Drive|Dr|Way|Close|Place|Pl|Square|Sq|Terrace|Ter|Crescent|Parkway|Pkwy|Highway|Hwy|Grove|Row|Hill"
    r"|STREET|ROAD|AVENUE|LANE|BLVD|CT|DRIVE|WAY|PLACE|SQUARE)\b\.?(?:,? (?:Flat|Apt\.?|Apartment|Unit|Suite) \d+\w?)?" + _CITY,
    rf"(?:(?:Am|An der|Auf der|Im|In der|Zum|Zur|Unter den|An den) )?(?:{_WORD}[ \-])?[{_UP}][\w\-]*(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|damm|ufer|STRASSE|STRAẞE|WEG|PLATZ)"
    rf" \d{{1,4}}(?: ?[a-zA-Z]\b)?" + _CITY,
    rf"(?:Am|An der|Auf der|Im|In der|Zum|Zur|Unter den) {_WORD} \d{{1,4}}(?: ?[a-z]\b)?, \d{{5}} {_WORD}(?: {_WORD})?",
    r"\d{1,4}(?: ?(?:bis|ter|quater|[A-D]))?,? (?:[Rr]ue|[Aa]venue|[Aa]v\.|[Bb]d\.?|[Bb]oulevard|[Cc]hemin|[Pp]lace|[Ii]mpasse|[Aa]llée|[Qq]uai|[Rr]oute|[Cc]ours|[Ss]quare|[Pp]assage|RUE|AVENUE|CHEMIN)"
    rf" (?:(?:de la|de l'|de l’|du|des|de|d'|d’|la|le|les|DE|DU|DES) ?)*{_WORD}(?: {_WORD})?" + _CITY,
    rf"(?:Calle|C/|Avda\.?|Avenida|Av\.|Plaza|Pza\.?|Paseo|P\.º|Camino|Ronda|Carrera|Travesía|CALLE|AVENIDA|PLAZA) ?(?:(?:de|del|la|las|los|el|DE) )*{_WORD}(?: {_WORD})?,? (?:n\.?º ?|núm\. ?)?\d{{1,4}}(?:,? \d{{1,2}}\.?[ºª](?: ?[A-Z]\b)?)?"
    + _CITY,
)
_ADDRESS_RES = [re.compile(r"(?<![\w.,\-])(?:" + p + ")") for p in _ADDRESSES]
_STREET_AFTER = re.compile(r"[ \-]?(?:Street|St\b|Road|Rd|Avenue|Ave|Lane|Blvd|Boulevard|Court|Ct\b|Drive|Way|Place|Square)", re.I)

_SPACE = "[   ]{1,2}"
_PART = r"(?:von der|van der|de la|von|van|de|del|di|da|du|le|zu|VON|DE|VAN)"
_PLAIN = rf"(?:(?:O|D|L)['’])?[{_UP}][{_LOW}{_UP}]+(?:-[{_UP}][{_LOW}{_UP}]+)*"
_NAMES = [
    ("given_family", re.compile(rf"(?<![\w.@\-])(?=(({_PLAIN})((?:{_SPACE}[{_UP}]\.)*)(?:{_SPACE}{_PART})?{_SPACE}({_PLAIN}))(?![\w@]))")),
    ("initial_family", re.compile(rf"(?<![\w.@\-])(?=(([{_UP}]\.)((?:{_SPACE}?[{_UP}]\.)*)(?:{_SPACE}{_PART})?{_SPACE}?({_PLAIN}))(?![\w@]))")),
    ("family_given", re.compile(rf"(?<![\w.@\-])(?=(({_PLAIN}),{_SPACE}({_PLAIN})((?:{_SPACE}[{_UP}]\.)*))(?![\w@]))")),
    ("family_initial", re.compile(rf"(?<![\w.@\-])(?=(({_PLAIN}),{_SPACE}([{_UP}]\.)((?:{_SPACE}?[{_UP}]\.)*)))")),
]

# Words that announce a kind of item, titles, and words that announce other numbers.
_CUES = {
    "phone": "tel telefon teléfono telephone téléphone phone call mobile handy móvil fax reached joignable erreichbar anrufen appeler llamar callback".split(),
    "id_number": "ssn passport passeport id ausweisnummer ausweis documento dni nie identité identity identidad steuer nino insurance".split(),
    "address": "anschrift address adresse dirección domicilio wohnt vive lives deliver near rue".split(),
    "email": "mail email e-mail cc contact write escribir écrire schreiben".split(),
}
_TITLES = frozenset("mr mrs ms miss dr prof sir herr frau hr fr mme mlle m monsieur madame sr sra srta don doña doctor doctora señor señora dra".split())
_OTHER_NUMBERS = frozenset("order ticket build range version section chapter page invoice isbn serial issue revision commit row line size".split())


@dataclass
class Span:
    kind: str
    start: int
    end: int
    shape: str
    strict: bool
    first: str = ""
    last: str = ""
    initials: int = 0
    x: list = field(default_factory=list)


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while end > start and text[end - 1] in " .,;:/-\n":
        end -= 1
    return start, end


def _islands(text: str) -> list[tuple[int, int]]:
    """Stretches around runs of digits, with room for what stands before and after them."""
    out: list[tuple[int, int]] = []
    for m in _ISLAND.finditer(text):
        a, b = max(0, m.start() - 16), m.end() + 24
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def candidates(text: str) -> list[Span]:
    """All proposed spans; they overlap, and many are nothing."""
    out = []
    if "@" in text or "＠" in text or _AT_SPELLED.search(text):
        for m in _EMAIL.finditer(text):
            tld = re.split(r"\W", m.group().rstrip())[-1]
            out.append(Span("email", *m.span(), "spelled" if _AT_SPELLED.search(m.group()) else "plain", tld.isalpha() and len(tld) > 1))
    return out + numbers(text) + addresses(text) + names(text)


def numbers(text: str) -> list[Span]:
    """Phone and identity numbers by format, and runs of seven digits and more as either."""
    out: list[Span] = []
    if not _ANY_DIGITS.search(text):
        return out
    strict = set()
    islands = _islands(text)
    for kind, table in (("phone", _PHONE_RES), ("id_number", _ID_RES)):
        for shape, pattern in table:
            for m in (m for a, b in islands for m in pattern.finditer(text, a, b)):
                if kind == "phone" and sum(map(str.isdigit, m.group())) < 7:
                    continue
                out.append(Span(kind, *_trimmed(text, *m.span()), shape, shape != "local"))
                strict.add(m.start())
    for m in (m for a, b in islands for m in _NUMBER.finditer(text, a, b)):
        if sum(map(str.isdigit, m.group())) >= 7 and m.start() not in strict:
            start = m.start() + (m.group()[0] == "(" and ")" not in m.group())
            if start not in strict:
                out += [Span(k, *_trimmed(text, start, m.end()), "run", False) for k in ("phone", "id_number")]
    return out


def addresses(text: str) -> list[Span]:
    if not _ANY_DIGITS.search(text):
        return []
    return [Span("address", *_trimmed(text, *m.span()), "street", True) for pattern in _ADDRESS_RES for m in pattern.finditer(text)]


def names(text: str) -> list[Span]:
    """Two words with capitals, or an initial and one, in either order."""
    out = []
    for shape, pattern in _NAMES:
        for m in pattern.finditer(text):
            if shape == "family_given":
                last, first, more = m.group(2), m.group(3), m.group(4)
            elif shape == "family_initial":
                last, first, more = m.group(2), "", m.group(3) + m.group(4)
            else:
                first, more, last = m.group(2), m.group(3), m.group(4)
                if shape == "initial_family":
                    first, more = "", first + more
            out.append(Span("name", m.start(1), m.end(1), shape, False, first, last, more.count(".")))
    return out


# --- context ---------------------------------------------------------------------------

_BEFORE = re.compile(r"[\w'’]+")
FEATURES = [
    *(f"is_{k}" for k in KINDS), "chars", "digits", "letters", "groups", "strict", "plus", "spelled", "cue", "other_number", "opened", "closed",
    "first_known", "last_known", "last_odds", "initials", "comma", "caps", "title", "before_odds", "street_after", "number_before", "hyphen", "line_start", "lone_initial", "phone_cue", "id_cue",
    "first_title", "last_title", "number_odds", "local", "first_before", "phrase",
]
_AT = {f: i for i, f in enumerate(FEATURES)}


@dataclass
class Lexicon:
    """Small tables that the tasks need: common words, given names, odds of endings and of words before."""

    words: frozenset
    given: frozenset
    odds: dict = field(default_factory=dict)

    def known(self, word: str) -> bool:
        if "-" in word or "'" in word or "’" in word:
            return all(p.lower() in self.words for p in re.split(r"[-'’]", word) if len(p) > 1)
        return word.lower() in self.words

    def is_given(self, word: str) -> bool:
        return any(p.lower() in self.given for p in word.split("-")) if word else False

    def family_odds(self, word: str) -> float:
        ends = [p.lower() for p in word.split("-") if p]
        return min((self.odds.get("end " + p[-4:], self.odds.get("end " + p[-3:], -1.0)) for p in ends), default=-1.0)


def _words_before(text: str, s: Span) -> list[str]:
    return [w.lower() for w in _BEFORE.findall(text[max(0, s.start - 40) : s.start].rsplit("\n\n", 1)[-1])][-4:]


def described(text: str, s: Span, lex: Lexicon) -> list[float]:
    """The features of one span, in the order of FEATURES."""
    piece = text[s.start : s.end]
    before = text[max(0, s.start - 40) : s.start]
    words = _words_before(text, s)
    near = words[-1] if words else ""
    cues = {k: any(w in c for w in words) for k, c in _CUES.items()}
    after = text[s.end : s.end + 14]
    prior = before.rstrip(" ")[-1:]
    name, number = s.kind == "name", s.kind in ("phone", "id_number")
    known_first = float(lex.known(s.first)) if s.first else 0.0
    return [
        *(float(s.kind == k) for k in KINDS),
        len(piece),
        sum(map(str.isdigit, piece)),
        sum(map(str.isalpha, piece)),
        len(_BEFORE.findall(piece)),
        float(s.strict),
        float(piece[:1] == "+" or piece[:2] in ("(+", "00")),
        float(s.shape == "spelled"),
        float(cues.get(s.kind, False)),
        float(near in _OTHER_NUMBERS or (number and any(w in _OTHER_NUMBERS for w in words[-2:]))),
        float(bool(prior) and prior in "([{<«\"'"),
        float(bool(after) and after[0] in ")]}>»\"',.;:"),
        known_first,
        float(lex.known(s.last)) if name else 0.0,
        lex.family_odds(s.last) if name else 0.0,
        s.initials,
        float(s.shape in ("family_given", "family_initial")),
        float(name and piece.upper() == piece),
        float(near in _TITLES),
        lex.odds.get("name after " + near, 0.0) if name else 0.0,
        float(bool(_STREET_AFTER.match(after))),
        float(bool(re.search(r"\d\w?,? ?\Z", before))),
        float("-" in s.last),
        float(not before or prior in ".!?:\n"),
        float(name and not s.first),
        float(cues["phone"]),
        float(cues["id_number"]),
        float(name and s.first.lower() in _TITLES),
        float(name and s.last.lower() in _TITLES),
        lex.odds.get("number after " + near, 0.0) if number else 0.0,
        float(s.shape == "local"),
        lex.odds.get("name after " + s.first.lower(), 0.0) if name and s.first else 0.0,
        lex.odds.get(_pair(s), 0.0) if name and s.first else 0.0,
    ]


def _pair(s: Span) -> str:
    return f"pair {s.first} {s.last}".lower()


def weak_label(s: Span, x: list[float], lex: Lexicon) -> int | None:
    """1, 0 or None (unknown): what strict formats and the given names say about a span."""
    f = lambda name: x[_AT[name]]
    if s.kind == "name":
        given, other = lex.is_given(s.first), lex.is_given(s.last)
        if f("first_title") or f("last_title") or f("street_after"):
            return 0 if not given or f("last_title") else None
        if not given and (other or f("first_before") > 1 or f("phrase") > 0):
            # what often stands before a name is a greeting, what all texts repeat a set phrase
            return 0
        if given and not f("number_before"):
            # a common word after a given name may be a family name; a title or greeting before tells
            return 1 if not f("last_known") or f("title") or f("before_odds") > 1 else None
        if s.first and f("first_known") and not given:
            return None if f("title") else 0
        return None
    if f("other_number") and not f("cue"):
        return 0
    if s.strict:
        if s.kind == "phone" and f("id_cue") and not f("phone_cue") and s.shape in ("nanp_run", "es", "de"):
            return None
        return 1
    if s.shape == "local" and f("phone_cue"):
        return 1
    return None if f("cue") else 0


# --- boosted trees ---------------------------------------------------------------------


@dataclass
class Model:
    """Boosted trees as flat arrays, with one threshold per kind."""

    trees: list
    lexicon: Lexicon
    threshold: dict
    # the trees were fitted on ids whose place by hash is below
    bound: int = 0

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for weight, feature, cut, left, right, value in self.trees:
            node = np.zeros(len(x), int)
            while True:
                inner = feature[node] >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(feature[node], 0)] <= cut[node]
                node = np.where(inner, np.where(go, left[node], right[node]), node)
            total += weight * value[node]
        return 1 / (1 + np.exp(-2 * total))


def _flat(tree, weight: float) -> tuple:
    feature, cut, left, right, value = [], [], [], [], []

    def add(node) -> int:
        i = len(feature)
        for a in (feature, cut, left, right, value):
            a.append(0)
        inner = node.getClass().getSimpleName() == "InternalNode"
        feature[i], value[i] = (node.split().featureIndex() if inner else -1), node.prediction()
        if inner:
            cut[i], left[i], right[i] = node.split().threshold(), add(node.leftChild()), add(node.rightChild())
        return i

    add(tree._call_java("rootNode"))
    return (weight, np.array(feature), np.array(cut, float), np.array(left), np.array(right), np.array(value, float))


def _lexicon(spark, vocab: DataFrame | None, given: DataFrame | None, limit: int = 200_000) -> Lexicon:
    """Both tables have a fixed size; more than ``limit`` rows are refused."""
    sets = []
    for t, c in ((vocab, "token"), (given, "given_name")):
        rows = [] if t is None else [r[0] for r in t.select(c).where(F.col(c).isNotNull() & ~F.col(c).startswith("##")).limit(limit + 1).collect()]
        if len(rows) > limit:
            raise ValueError(f"{c}: more than {limit} rows")
        sets.append(frozenset(r.lower() for r in rows))
    return Lexicon(*sets)


def _evidence(text: str, lex: Lexicon):
    """``(key, yes)``: endings of names and words before spans, where the tables tell what a span is."""
    for s in names(text):
        if not s.first:
            continue
        given = lex.is_given(s.first)
        yield _pair(s), given
        if (given or lex.known(s.first)) and not lex.known(s.last):
            for p in s.last.lower().split("-"):
                if p:
                    yield "end " + p[-4:], given
                    if len(p) > 3:
                        yield "end " + p[-3:], given
            before = _words_before(text, s)
            if before:
                yield "name after " + before[-1], given
    for s in numbers(text):
        before = _words_before(text, s)
        if before and s.shape != "local":
            yield "number after " + before[-1], s.strict


def _odds(documents: DataFrame, lex: Lexicon, limit: int) -> dict:
    """Log odds of every ending and word seen three times and more, over all documents.

    Of pairs of words in the place of a name, those in more than two of a thousand texts
    are kept, with the logarithm of their number in a thousand; there cannot be many.
    """
    texts = documents.where("text is not null").count()
    sent = documents.sparkSession.sparkContext.broadcast(lex)

    def run(batches):
        for b in batches:
            count: dict = {}
            for t in b.column("text").to_pylist():
                for k, yes in _evidence(t, sent.value):
                    c = count.setdefault(k, [0, 0])
                    c[not yes] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), *(pa.array([c[j] for c in count.values()], pa.int64()) for j in (0, 1))], ["k", "yes", "no"])

    seen = documents.select("text").where("text is not null").mapInArrow(run, "k string, yes long, no long")
    seen = seen.groupBy("k").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    least = F.when(F.col("k").startswith("pair "), F.lit(max(10.0, texts * 0.002))).otherwise(F.lit(3.0))
    rows = seen.where(F.col("yes") + F.col("no") >= least).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} endings and words before names")
    return {r.k: float(np.log(1000 * (r.yes + r.no) / texts) if r.k.startswith("pair ") else np.log((r.yes + 0.5) / (r.no + 0.5))) for r in rows}


_PLACES = 1 << 30


def _place(key: str = "doc_id"):
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(_PLACES))


def trained(documents: DataFrame, vocab: DataFrame | None, given: DataFrame | None, *, sample: int = 2000, trees: int = 20, depth: int = 4, limit: int = 1_000_000) -> Model:
    """Boosted trees on the spans of at most ``sample`` texts (at most half of all), drawn by hash of their id.

    Names are labelled by the table of given names but described without it, so that the
    trees carry over to names that the table lacks. Odds of endings and of words before a
    span are counted over all documents (more than ``limit`` of them are refused). Without
    any span of both labels the thresholds alone decide, on formats.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    spark = documents.sparkSession
    lex = _lexicon(spark, vocab, given)
    lex.odds = _odds(documents, lex, limit)
    sent = spark.sparkContext.broadcast(lex)
    texts = documents.select("doc_id", "text").where("text is not null and doc_id is not null")
    bound = int(_PLACES * min(0.5, 0.9 * sample / max(1, texts.count())))

    def described_rows(batches):
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                for s in candidates(t):
                    x = described(t, s, sent.value)
                    y = weak_label(s, x, sent.value)
                    if y is not None:
                        rows.append((float(y), x))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate((pa.float64(), pa.list_(pa.float64())))], ["label", "x"])

    drawn = texts.where(_place() < bound).limit(sample).repartition(max(2, spark.sparkContext.defaultParallelism))
    # the sample is small: few files, so that the many passes of the fit are few tasks
    spans = staged(drawn.mapInArrow(described_rows, "label double, x array<double>").coalesce(2))
    model = Model([], lex, dict.fromkeys(KINDS, 0.5), bound)
    if spans.select("label").distinct().count() == 2:
        fitted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=1, maxBins=64).fit(spans.select("label", array_to_vector("x").alias("features")))
        model.trees = [_flat(t, w) for t, w in zip(fitted.trees, fitted.treeWeights)]
    return model


_SPANS = "array<struct<start:int,end:int,kind:tinyint,strict:boolean,score:float,label:tinyint>>"


def scored(documents: DataFrame, model: Model, *, key: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """``(k, spans)``, with ``keep_text`` also ``t``: every proposed span of every text with its score and weak label (-1: unknown)."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    kept = ["k", "t"] if keep_text else ["k"]
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int8()), ("strict", pa.bool_()), ("score", pa.float32()), ("label", pa.int8())])

    def run(batches):
        model = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = part.column("t").to_pylist()
                own = [candidates(t) if t else [] for t in texts]
                x = [described(t, s, model.lexicon) for t, spans in zip(texts, own) for s in spans]
                flat = [s for spans in own for s in spans]
                label = [-1 if y is None else y for y in (weak_label(s, r, model.lexicon) for s, r in zip(flat, x))]
                p = (model.score(np.array(x)) if x else []) if model.trees else [float(y == 1) for y in label]
                made = pa.StructArray.from_arrays(
                    [pa.array(v, f.type) for v, f in zip(([s.start for s in flat], [s.end for s in flat], [KINDS.index(s.kind) for s in flat], [s.strict for s in flat], np.asarray(p, np.float32), label), kind)],
                    fields=list(kind),
                )
                ends = np.r_[0, np.cumsum([len(spans) for spans in own])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.ListArray.from_arrays(pa.array(ends), made)], [*kept, "spans"])

    d = documents.select(F.col(key).alias("k"), F.col("text").alias("t"))
    kinds = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    return d.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + f", spans {_SPANS}")


def calibrated(model: Model, rows: DataFrame, *, precision: float = 0.98, bins: int = 1000) -> Model:
    """``model`` with the threshold of each kind at which most labelled items right above wrong are kept.

    Scores of all labelled spans of the texts that the trees were not fitted on are
    counted in ``bins`` per kind and label; only these counts reach the driver.
    """
    from dataclasses import replace

    spans = rows.where(F.col("k").isNull() | (_place("k") >= model.bound)).select(F.explode("spans").alias("s")).where("s.label >= 0")
    bin_ = F.least(F.floor(F.col("s.score") * bins), F.lit(bins - 1)).cast("int")
    count = np.zeros((len(KINDS), 2, bins))
    for r in spans.groupBy(F.col("s.kind").alias("kind"), F.col("s.label").alias("label"), bin_.alias("bin")).count().collect():
        count[r.kind, r.label, r.bin] = r["count"]
    found = dict(model.threshold)
    for i, kind in enumerate(KINDS):
        no, yes = count[i]
        if model.trees and yes.any():
            down = np.nonzero(yes + no)[0][::-1]
            right, wrong = np.cumsum(yes[down]), np.cumsum(no[down])
            gain = np.where(right >= precision * (right + wrong), right - wrong, -np.inf)
            if np.isfinite(gain.max()):
                # halfway to the next lower score, but never above even odds
                j = int(np.argmax(gain))
                low = (down[j + 1] + 1) / bins if j + 1 < len(down) else 0.0
                found[kind] = float(np.clip((down[j] / bins + low) / 2, 0.05, 0.5))
    return replace(model, threshold=found)


def fit(documents: DataFrame, vocab: DataFrame | None, given: DataFrame | None, **options) -> Model:
    """The model for ``documents``: trees as in ``trained``, thresholds as in ``calibrated``."""
    model = trained(documents, vocab, given, **options)
    return calibrated(model, scored(documents, model))


_RANK = {"email": 3, "address": 2, "id_number": 1, "phone": 1, "name": 0}


def _apart(spans: list[dict], threshold: dict) -> list[tuple[int, int, str]]:
    """The best spans above their thresholds that do not overlap."""
    good = []
    for s in spans:
        kind = KINDS[s["kind"]]
        if s["score"] >= threshold[kind]:
            good.append((_RANK[kind], s["strict"], round(s["score"], 2), s["end"] - s["start"], -s["start"], s["end"], kind))
    taken: list[tuple[int, int, str]] = []
    for *_, start, end, kind in sorted(good, reverse=True):
        start = -start
        if all(end <= a or start >= b for a, b, _ in taken):
            taken.append((start, end, kind))
    return sorted(taken)


def redacted_text(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with typed placeholders in place of the items, otherwise unchanged."""
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join(out) + text[at:]


def personal_items(documents: DataFrame, model: Model, *, key: str = "doc_id") -> DataFrame:
    """``(doc_id, kind, char_start, char_end)`` of each item of personal information.

    Offsets are zero-based code points, the end is exclusive. Null and empty texts have
    none; repeated rows count once; other columns are ignored; texts of any length are
    read whole.
    """
    return items_of(scored(documents.where("text is not null and text <> ''"), model, key=key), model)


def items_of(rows: DataFrame, model: Model) -> DataFrame:
    """The items of texts whose spans are ``scored``."""
    threshold = model.threshold

    def run(batches):
        for b in batches:
            out = [(i, kind, a, e) for i, own in zip(b.column("k").to_pylist(), b.column("spans").to_pylist()) for a, e, kind in _apart(own, threshold)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate((pa.int64(), pa.string(), pa.int32(), pa.int32()))], ["doc_id", "kind", "char_start", "char_end"])

    return rows.select("k", "spans").mapInArrow(run, "doc_id long, kind string, char_start int, char_end int").distinct()


def redacted(documents: DataFrame, model: Model, *, key: str = "doc_id") -> DataFrame:
    """``(doc_id, items, text)``: every text with placeholders; null stays null, empty stays empty."""
    return redacted_of(scored(documents, model, key=key, keep_text=True), model)


def redacted_of(rows: DataFrame, model: Model) -> DataFrame:
    """The redacted texts of rows whose spans are ``scored`` with their text."""
    threshold = model.threshold

    def run(batches):
        for b in batches:
            found = [_apart(own, threshold) for own in b.column("spans").to_pylist()]
            out = [redacted_text(t, f) if t else t for t, f in zip(b.column("t").to_pylist(), found)]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array([len(f) for f in found], pa.int32()), pa.array(out, pa.string())], ["doc_id", "items", "text"])

    return rows.select("k", "t", "spans").mapInArrow(run, "doc_id long, items int, text string")
