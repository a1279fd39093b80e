"""Languages of documents and of the stretches of mixed documents, by error-correcting output codes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.topn import top_n_per_group

#: The languages, their three-letter codes and English names.
LANGUAGES = {
    "en": ["eng", "english"],
    "de": ["deu", "ger", "german"],
    "fr": ["fra", "fre", "french"],
    "es": ["spa", "spanish"],
    "pt": ["por", "portuguese"],
    "it": ["ita", "italian"],
    "nl": ["nld", "dut", "dutch"],
    "sv": ["swe", "swedish"],
    "ru": ["rus", "russian"],
    "ja": ["jpn", "japanese"],
}
CODES = list(LANGUAGES)

#: The model is fitted on so many labelled documents of a language at most, of at most so many characters each.
SAMPLE_PER_LANGUAGE = 400
SAMPLE_CHARS = 20_000
#: Hashed n-grams go to 2 ** 16 places.
HASH_BITS = 16
#: n-grams of one to four characters, and whole words.
ORDERS = (1, 2, 3, 4)
SMOOTHING = 2e-6
#: What changing the language between two sentences costs, in units of the decoding loss.
SWITCH = 7.0
#: A stretch whose best language beats the next by less than this probability is called ambiguous.
CLEAR = 0.9

_END = re.compile("""\\n|[.!?…]["'”’»)\\]]?(?=[^\\S\\n])|[。！？]+[」』）]?""")
#: Links, addresses, code, and words with digits or signs inside say nothing of the language.
_SPACED = r"[^\s\p{Han}\p{Hiragana}\p{Katakana}"
_SIGNS = r"\d_=\\/<>{}@#"
_NOISE = regex.compile(rf"\bwww\.\S+|`[^`\n]*+`|(?<!{_SPACED}])(?={_SPACED}{_SIGNS}]*+[{_SIGNS}]){_SPACED}]++")
_NO_SPACES = re.compile("[\u2e80-\ua4cf\uf900-\ufaff\uff00-\uffef\U0001b000-\U0001b16f\U00020000-\U0003ffff]")  # where words may have none between
_SIGN = re.compile(r"[\d_=\\/<>{}@#]")
_ASCII_WORD = re.compile("[A-Za-z]+")
_MAYBE_NOISE = re.compile(r"[\d_=\\/<>{}@#`]|www\.")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*+")
_FENCED = regex.compile(r"^[ \t]*+(```|~~~).*?(?:^[ \t]*+\1[^\S\n]*+$|\Z)", regex.M | regex.S)
_NAMES = regex.compile(r"(?:[^\p{L}]*+\p{Lu}[\p{Ll}\p{M}]++)++[^\p{L}]*+")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]{4}")
_SENTENCE_END = regex.compile(r"""[.!?…。！？]+["'”’»)\]」』）]?\s*+\Z""")
#: A line without a sentence's end is a whole sentence if it has so many words ...
LEAST_WORDS = 4
#: ... or, written without spaces, so many letters; one with a sentence's end if it has two.
LEAST_UNSPACED = 6
#: What a fragment may add to the cost of a language; below SWITCH, so it opens no stretch by itself.
FRAGMENT = 2.0
#: Sentences are worked on in blocks of about so many characters, which bounds memory.
_BLOCK = 200_000


def codewords() -> np.ndarray:
    """(languages, 15) of -1 and 1: words of the BCH(15, 5) code, any two of which differ in 7 bits or more.

    The word of message m is m times the generator x^10 + x^8 + x^5 + x^4 + x^2 + x + 1. Messages
    are every third number, so that no bit is the same in all words.
    """
    words = []
    for m in range(1, 3 * len(CODES), 3):
        word = 0
        for bit in range(5):
            if m >> bit & 1:
                word ^= 0b10100110111 << bit
        words.append([1 if word >> b & 1 else -1 for b in range(15)])
    return np.array(words, dtype=np.float32)


def label_code(label: Column) -> Column:
    """The two-letter code a label names in any usual writing (region, three letters, English name), else NULL."""
    names = {n: code for code, more in LANGUAGES.items() for n in (code, *more)}
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.regexp_extract(F.lower(F.trim(label)), r"^[a-z]+", 0))


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences and lines of a text; blank ones and fenced code are left out."""
    if "```" in text or "~~~" in text:
        text = _FENCED.sub(lambda m: regex.sub(r"[^\n]", " ", m[0]), text)
    out, start = [], 0
    for m in _END.finditer(text):
        a, b = m.span()
        end = a if text[a] == "\n" else b
        if end > start and not text[start:end].isspace():
            out.append((start, end))
        start = b
    if start < len(text) and not text[start:].isspace():
        out.append((start, len(text)))
    return out


def letters(sentence: str) -> str:
    """What of a sentence is language: lower-case words between single spaces; empty if it has none."""
    if _MAYBE_NOISE.search(sentence):
        if "`" in sentence or "www." in sentence or _NO_SPACES.search(sentence):
            sentence = _NOISE.sub(" ", sentence)
        else:  # the same, word by word
            sentence = " ".join([w for w in sentence.split() if not _SIGN.search(w)])
    words = _ASCII_WORD.findall(sentence) if sentence.isascii() else _WORD.findall(sentence)
    return f" {' '.join(words).lower()} " if words else ""


def whole(sentence: str, words: str) -> bool:
    """Whether a sentence, of which letters() left words, is more than names, a heading or a fragment.

    What ends like a sentence and has two words is one, however short; whether it opens a stretch is for its loss
    to say. Other lines need LEAST_WORDS. Capitalised names alone are none.
    """
    count, ends = words.count(" ") - 1, bool(_SENTENCE_END.search(sentence))
    if count >= (2 if ends else LEAST_WORDS):
        return not _NAMES.fullmatch(sentence)
    if ends:
        return len(words) > 3 and bool(_NO_SPACES.search(words))
    return len(words) - 2 >= LEAST_UNSPACED and bool(_UNSPACED.search(words))


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashed n-grams, index of their text) for each order and for whole words, in the order of the texts."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    mul, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - HASH_BITS)
    rolling = np.zeros(len(chars), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(chars) - n + 1
        if m <= 0:
            return
        rolling = (rolling[:m] ^ chars[n - 1 : n - 1 + m]) * mul + np.uint64(n)
        rolling ^= rolling >> np.uint64(29)
        good = of[:m] == of[n - 1 : n - 1 + m]
        if n == 1:
            good &= chars != 32
        yield ((rolling * mul) >> shift)[good].astype(np.int64), of[:m][good]
    # Whole words: the sum of their characters' hashes, with their length and first letter.
    edge = np.flatnonzero(chars == 32)
    mixed = np.cumsum((chars * mul) ^ ((chars * mul) >> np.uint64(31)))
    a, b = edge[:-1], edge[1:]
    good = (b > a + 1) & (of[a] == of[b])
    a, b = a[good], b[good]
    word = (mixed[b - 1] - mixed[a]) * mul + (chars[a + 1] * np.uint64(31) + (b - a).astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    yield ((word * mul) >> shift).astype(np.int64), of[a]


def _counts(texts: list[str], labels: np.ndarray, use: np.ndarray, size: int) -> np.ndarray:
    """(languages, size): how often each hashed n-gram occurs in the texts in use of each language, block by block."""
    out = np.zeros(len(CODES) * size)
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= _BLOCK):
            chars += len(texts[end])
            end += 1
        own, mine = labels[at:end] * size, use[at:end]
        for hashed, owner in features(texts[at:end]):
            good = mine[owner]
            out += np.bincount(hashed[good] + own[owner[good]], minlength=len(out))
        at = end
    return out.reshape(len(CODES), size)


@dataclass(frozen=True)
class LanguageModel:
    """Weights of one binary n-gram classifier per bit of the codewords, and how far each is to be trusted."""

    weights: np.ndarray  # (2 ** HASH_BITS, 15)
    trust: np.ndarray  # (15,)
    scale: float

    def losses(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): the trust-weighted logistic loss of each codeword against the classifiers' margins."""
        out = np.zeros((len(texts), len(CODES)), dtype=np.float32)
        code, at = codewords(), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= _BLOCK):
                size += len(texts[end])
                end += 1
            out[at:end] = self._decode(self._margins(texts[at:end]), code)
            at = end
        return out

    def _margins(self, texts: list[str]) -> np.ndarray:
        margins = np.zeros((len(texts), self.weights.shape[1]), dtype=np.float32)
        if len(texts) == 1 and len(texts[0]) > 2 * _BLOCK:  # one very long sentence, in parts
            for k in range(0, len(texts[0]), _BLOCK):
                margins += self._margins([texts[0][k : k + _BLOCK]])
            return margins
        for hashed, owner in features(texts):
            if len(hashed):
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                margins[owner[starts]] += np.add.reduceat(self.weights.take(hashed, axis=0), starts, axis=0)
        return margins * self.scale

    def _decode(self, margins: np.ndarray, code: np.ndarray) -> np.ndarray:
        """ln(1 + exp(-code * margin)) of every bit, weighted and summed; bits are only ever 1 or -1."""
        if_one, if_not = np.logaddexp(0, -margins) * self.trust, np.logaddexp(0, margins) * self.trust
        return if_one @ (code > 0).T.astype(np.float32) + if_not @ (code < 0).T.astype(np.float32)

    @classmethod
    def fit(cls, texts: list[str], labels: np.ndarray, rounds: int = 3) -> LanguageModel:
        """Fit on letters() of sentences and the indexes of their documents' labels, some of them wrong.

        Every round after the first drops the sentences that the model before it gives to another
        language, so wrong labels and foreign sentences do not stay in.
        """
        size, code = 1 << HASH_BITS, codewords()
        labels, keep = np.asarray(labels), np.ones(len(texts), dtype=bool)
        held = np.arange(len(texts)) % 5 == 4
        model = None
        for step in range(rounds):
            use = keep & ~held if step == rounds - 2 else keep
            share = _counts(texts, labels, use, size)
            share /= np.maximum(1.0, share.sum(axis=1, keepdims=True))
            weights = np.empty((size, code.shape[1]), dtype=np.float32)
            for b in range(code.shape[1]):
                pos, neg = share[code[:, b] > 0].mean(axis=0), share[code[:, b] < 0].mean(axis=0)
                weights[:, b] = np.log((pos + SMOOTHING) / (neg + SMOOTHING))
            trust = np.ones(code.shape[1], dtype=np.float32) if model is None else model.trust
            model = cls(weights, trust, 0.1)
            found = model.losses(texts).argmin(axis=1)
            keep = found == labels
            if step == rounds - 2:  # trust by held-out accuracy of each bit
                test = held & keep
                if test.any():
                    margins = model._margins([t for t, x in zip(texts, test) if x])
                    right = ((margins > 0) == (code[labels[test]] > 0)).mean(axis=0).clip(0.55, 0.999)
                    odds = np.log(right / (1 - right))
                    model = cls(weights, (odds / odds.mean()).astype(np.float32), 0.1)
        return model


def stretches(spans: list[tuple[int, int]], losses: np.ndarray, spoken: np.ndarray, full: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(start, end, language, confidence) of the stretches of one text, by the cheapest path through
    its sentences, where changing the language costs SWITCH. Sentences without letters go with the
    one before, and fragments open no stretch, unless the text has nothing else. ``losses`` has a row
    for each sentence, ``spoken`` says which have letters, ``full`` which are whole sentences."""
    use = np.flatnonzero(spoken)
    if not len(use):
        return []
    cost = losses[use] - losses[use].min(axis=1, keepdims=True)
    sure = full[use]
    if sure.any():
        cost = np.where(sure[:, None], cost, np.minimum(cost, FRAGMENT / (1 + (~sure).sum())))
    elif len(use) > 1:  # fragments alone: one stretch, of the language that suits them together
        cost[:] = cost.sum(axis=0) / len(use)
    best = cost.argmin(axis=1)
    best = np.where(sure, best, best[np.argmax(sure)])
    if (best == best[0]).all():
        path = best
    else:
        total, came = cost[0].copy(), np.zeros((len(use), cost.shape[1]), dtype=np.int8)
        for k in range(1, len(use)):
            low = int(total.argmin())
            stay = total <= total[low] + SWITCH
            came[k] = np.where(stay, np.arange(len(total)), low)
            total = np.where(stay, total, total[low] + SWITCH) + cost[k]
        path = np.empty(len(use), dtype=np.int64)
        path[-1] = total.argmin()
        for k in range(len(use) - 1, 0, -1):
            path[k - 1] = came[k][path[k]]
    edges = np.flatnonzero(np.r_[True, path[1:] != path[:-1], True])
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        loss = cost[a:b].sum(axis=0)
        chance = np.exp(-(loss - loss.min()))
        start = spans[use[a]][0] if out else spans[0][0]
        end = spans[use[b] - 1][1] if b < len(use) else spans[-1][1]
        out.append((start, end, int(path[a]), float(chance[path[a]] / chance.sum())))
    return out


def fit_languages(df: DataFrame, key: str, text: str, label: str, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Fit on a bounded sample: at most ``per_language`` labelled documents of each language, chosen by a
    hash of the key, none longer than SAMPLE_CHARS characters. Wrong labels are expected."""
    rows = df.select(F.col(key).alias("k"), label_code(F.col(label)).alias("g"), F.col(text).alias("t")).where(
        f"g IS NOT NULL AND k IS NOT NULL AND length(t) BETWEEN 1 AND {SAMPLE_CHARS}"
    )
    chosen = top_n_per_group(rows.select("g", "k", F.xxhash64("k").cast("double").alias("s")), "g", "k", "s", per_language)
    sample = rows.join(F.broadcast(chosen.select(F.col("k"))), "k").select("g", "t").collect()  # bounded as said
    texts, labels = [], []
    for r in sample:
        for a, b in sentences(r.t):
            words = letters(r.t[a:b])
            if words:
                texts.append(words)
                labels.append(CODES.index(r.g))
    if not texts:
        texts, labels = [" a "], [0]
    return LanguageModel.fit(texts, np.array(labels))


def find_languages(
    df: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", label: str | None = "lang"
) -> DataFrame:
    """(key, label, seg, lang, confidence, start, end, ambiguous): one row for each stretch of each text in one language.

    seg counts from 0 in order of the text; adjoining stretches differ in language; start and end
    are characters. A stretch has at least one whole sentence or line. A text without words (NULL
    and empty ones too) has one row with seg 0, a NULL lang and confidence 0. ``label`` is passed on
    as the code it names, or NULL, and plays no part in the finding. Keys are kept as they are; an
    empty table gives no rows; other columns are ignored.

    Each sentence's n-grams give a margin for each bit of the codewords; the codeword of least
    trust-weighted loss is its language, and a cheapest path over the sentences of a text keeps one
    that is unsure (a name, a fragment) with its neighbours.
    """
    shipped = df.sparkSession.sparkContext.broadcast((model.weights, model.trust, model.scale))  # of fixed size; workers may lack the package
    kind = df.schema[key].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel(*shipped.value)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            spans = [sentences(t) if t else [] for t in texts]
            words = [letters(t[a:b]) for t, own in zip(texts, spans) for a, b in own]
            losses, spoken = model.losses(words), np.array([bool(w) for w in words], dtype=bool)
            lines = (t[a:b] for t, own in zip(texts, spans) for a, b in own)
            full = np.array([bool(w) and whole(x, w) for x, w in zip(lines, words)], dtype=bool)
            at, rows, found = 0, [], []
            for row, own in enumerate(spans):
                mine = slice(at, at + len(own))
                at += len(own)
                parts = stretches(own, losses[mine], spoken[mine], full[mine]) or [(0, len(texts[row] or ""), None, 0.0)]
                rows += [row] * len(parts)
                found += [(k, *p) for k, p in enumerate(parts)]
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(take),
                    batch.column(1).take(take),
                    pa.array([f[0] for f in found], pa.int32()),
                    pa.array([None if f[3] is None else CODES[f[3]] for f in found], pa.string()),
                    pa.array([round(f[4], 6) for f in found], pa.float64()),
                    pa.array([f[1] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.int64()),
                    pa.array([f[3] is not None and f[4] < CLEAR for f in found]),
                ],
                names=["k", "label", "seg", "lang", "confidence", "start", "end", "ambiguous"],
            )

    named = F.lit(None).cast("string") if label is None else label_code(F.col(label))
    rows = df.select(F.col(key).alias("k"), named.alias("label"), F.col(text).alias("t"))
    schema = f"k {kind}, label string, seg int, lang string, confidence double, start bigint, end bigint, ambiguous boolean"
    return rows.mapInArrow(find, schema).withColumnRenamed("k", key)


def wrongly_labelled(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, seg, lang) of the documents with words whose label is missing or wrong, or that are mixed.

    Keys must be unique in the table that find_languages read.
    """
    mixed = found.where("seg = 1").select(key)
    first = found.where("seg = 0 AND lang IS NOT NULL AND NOT (label <=> lang)").select(key)
    return found.where("lang IS NOT NULL").join(mixed.unionAll(first), key, "left_semi").select(key, "seg", "lang")
