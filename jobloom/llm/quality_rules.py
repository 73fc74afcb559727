"""Quality rules: word and line counts, and compression bands.

A text of natural language compresses by a factor that depends on its length.
Each length band has a lower and an upper limit for the zstandard ratio
(bytes before over bytes after); beyond them a whole document is repetitive
or incompressible.  Long documents are also cut into fixed chunks, whose
ratios have limits of their own; a shorter last chunk has those of a whole
document of its length.  A document fails if chunks outside them hold too large
a share of its bytes.

Edge cases: a null or empty text has no words and fails the base rule; rows
are judged one by one, so repeated rows and extra columns have no effect.
"""

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from jobloom.llm.common import SPACED_WORD, small_batches

WORD = re.compile(SPACED_WORD)
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits by length: ``upto`` bytes, then least and greatest ratio.

    Very short texts have room for the frame header and little else, so their
    limits are wide.  Base64 and hex noise stays under 1.4 at any length.
    """

    whole: tuple = ((64, 0.0, 2.5), (128, 0.5, 2.5), (256, 0.9, 3.0), (512, 1.1, 3.2), (1024, 1.25, 3.5), (4096, 1.4, 4.0), (16384, 1.45, 5.0), (None, 1.45, 6.0))
    chunk_bytes: int = 4096
    chunk: tuple = (1.4, 4.5)
    bad_share: float = 0.3
    level: int = 3


def ratio(data: bytes, compressor) -> float:
    return len(data) / len(compressor.compress(data)) if data else 1.0


def band_verdict(data: bytes, bands: Bands, compressor) -> tuple[float, float, bool]:
    """Ratio of the whole, share of bytes in chunks outside the limits, passed."""
    whole = ratio(data, compressor)
    limits = lambda n: next((a, b) for upto, a, b in bands.whole if upto is None or n <= upto)
    low, high = limits(len(data))
    size = bands.chunk_bytes
    bad = 0
    for at in range(0, len(data) if len(data) >= size else 0, size):
        chunk = data[at:at + size]
        least, most = bands.chunk if len(chunk) == size else limits(len(chunk))
        bad += len(chunk) * (not least <= ratio(chunk, compressor) <= most)
    share = bad / len(data) if data else 0.0
    return whole, share, low <= whole <= high and share < bands.bad_share


def repeated_words(words: list[str]) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(words)
    if n < 3:
        return 0
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    pair = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    _, inverse, count = np.unique(pair[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    covered = np.zeros(n, bool)
    at = np.flatnonzero(count[inverse] > 1)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def measure(text: str, bands: Bands, compressor) -> tuple:
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), *band_verdict(text.encode(), bands, compressor))


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, bad_share double, in_bands boolean"


def measures(docs: DataFrame, bands: Bands = Bands(), text: str = "text") -> DataFrame:
    """Add the struct ``rules``: counts, compression ratios, and both verdicts."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(MEASURES)
    def run(texts: pd.Series) -> pd.DataFrame:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        return pd.DataFrame([measure(t, bands, compressor) for t in texts.fillna("")], columns=[c.split()[0] for c in MEASURES.split(", ")])

    out = docs.withColumn("rules", run(F.col(text)))
    r = lambda c: F.col(f"rules.{c}")
    failed = (r("n_words") < 50) | (100 * r("n_repeat_words") > 50 * r("n_words"))
    return out.withColumn("rules", F.col("rules").withField("base_failed", failed).withField("kept", ~failed & r("in_bands")))
