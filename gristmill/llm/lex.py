"""Words, scripts and function words shared by the text operators."""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

#: Ideographs of Chinese, as ranges of a regex character class.
HAN = "㐀-䶿一-鿿豈-﫿\U00020000-\U0002ebef"
#: A maximal run of letters and digits.
WORD = re.compile(r"[^\W_]+")
#: The same, but every ideograph alone.
WORD_HAN = re.compile(f"[{HAN}]|[^\\W_{HAN}]+")

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the be to of and a in that have it for not on with he as you do at this but his by from they we say her she or an will my one all would there their what so up out if about who get which go me when make can like no just him know take into your some could them see other than then now only its over also back after use how our even want because any these us is are was were been has had more most such neither nor every under between until without whose did does very too".split(),
    "de": "der die das und in zu den von mit ist des im dem nicht ein eine als auch es an auf für so dass sich er sie wir ich war wie aus bei nach wenn nur noch werden wurde wurden haben hat hatte ihre sein seine einen einem einer oder aber denn weil vor zum zur über um am man kann muss soll alle uns keiner ohne weder niemand was wo bis hier dann doch".split(),
    "fr": "le la les de des du un une et en est que qui dans pour pas sur au aux avec ce cette il elle nous vous ils ne se sa son ses par plus ou mais donc car si comme était ont été sont avait sans entre peu tout tous y a aussi dont on lui leur même ni d l c n qu s j".split(),
    "es": "el la los las de del un una y en es que por para con no se su sus lo al como más pero o si era fue han ha sido está este esta ese esa sin entre muy todo ya también le les nos nosotros ellos hay ni cuando porque aunque antes después luego casi".split(),
}
COMMON = frozenset(w for ws in FUNCTION_WORDS.values() for w in ws)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def words_han(text: str | None) -> list[str]:
    return WORD_HAN.findall(text.lower()) if text else []


class Hashes(dict):
    """word -> 64-bit hash, the same in every process; emptied when it gets large."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word) >> 1
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def flat_hashes(docs: Iterable[list[str]], cache: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``docs`` in one array, and where each document begins (one more entry at the end)."""
    out: list[int] = []
    starts = [0]
    for ws in docs:
        out += [cache[w] for w in ws]
        starts.append(len(out))
    return np.array(out, dtype=np.uint64), np.array(starts, dtype=np.int64)


def plain(text: str) -> str:
    """Compatibility forms and accents taken off, in lower case."""
    text = unicodedata.normalize("NFKD", text.lower())
    return "".join(c for c in text if not unicodedata.combining(c))


def batches(pdfs: Iterator, rows: int = 500) -> Iterator:
    """Pieces of at most ``rows`` rows, so that the arrays made of one piece stay small."""
    for pdf in pdfs:
        for i in range(0, len(pdf), rows):
            yield pdf.iloc[i : i + rows]


def sampled_texts(df, id_col: str, text_col: str, limit: int) -> list[str]:
    """At most ``limit`` texts of ``df``, those of the least hashes of their ids.

    The hashes are picked first and only then the texts that belong to them, so that a
    task never sends more than its share of the texts to the driver.
    """
    from pyspark.sql import functions as F

    hashed = df.select(F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"))
    top = hashed.select("h").orderBy("h").limit(limit)
    rows = hashed.join(F.broadcast(top.distinct()), "h", "left_semi").collect()
    return [r["text"] for r in sorted(rows, key=lambda r: (r["h"], r["text"]))][:limit]
