"""Fill-in-middle: texts cut into prefix, middle and suffix at unit boundaries and written out around sentinels."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendtrail.llm.common import table_key

FLUSH = 8 << 20  # characters of output in a batch, about
BREAK, SPACE, OTHER = 0, 1, 2  # classes of code points
_SPACES = np.array([*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)

#: Whether a unit ends between a code point of the first class and one of the second.
UNITS = {
    "line": np.array([[True] * 3, [False] * 3, [False] * 3]),  # behind each newline
    "word": np.array([[False] * 3, [False] * 3, [True, True, False]]),  # before the white space that follows a word
    "char": np.ones((3, 3), bool),
}


@dataclass(frozen=True)
class FillInMiddle:
    """``rate`` per cent of the texts are cut, ``spm`` per cent of these with the suffix first. ``sentinels`` come before prefix,
    suffix and middle; a text that holds one stays plain. Draws come from sha256 of ``seed`` and the id."""

    unit: str = "line"
    rate: int = 100
    spm: int = 50
    seed: int = 7
    sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")

    def __post_init__(self):
        if self.unit not in UNITS:
            raise ValueError(f"unit is one of {', '.join(UNITS)}")
        if not all(self.sentinels) or any(a[0] in b[1:] or (i != j and b.startswith(a)) for i, a in enumerate(self.sentinels) for j, b in enumerate(self.sentinels)):
            raise ValueError("sentinels must not be empty, begin one another or hold each other's first character further on")

    def draws(self, key: object) -> list[int]:
        name = hashlib.sha256(f"{self.seed}:{'' if key is None else key}".encode()).digest()
        return np.frombuffer(name[:16], ">u4").tolist()

    def apply(self, key: object, text: str) -> tuple[str, int, str, int | None, int | None]:
        """(output, units, form, characters of the prefix, of the middle)."""
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        edges = boundaries(points, self.unit)
        n = len(edges) - 1
        a, b, cut, first = self.draws(key)
        if not text or cut % 100 >= self.rate or any(s in text for s in self.sentinels):
            return text, n, "plain", None, None
        low, high = sorted((a % (n + 1), b % (n + 1)))
        start, stop = int(edges[low]), int(edges[high])
        prefix, middle, suffix = (part.tobytes().decode("utf-32-le") for part in (points[:start], points[start:stop], points[stop:]))
        p, s, m = self.sentinels
        if first % 100 < self.spm:
            return s + suffix + p + prefix + m + middle, n, "spm", start, stop - start
        return p + prefix + s + suffix + m + middle, n, "psm", start, stop - start


def boundaries(points: np.ndarray, unit: str) -> np.ndarray:
    """Places where units begin, and the end: unit i is ``points[out[i]:out[i + 1]]``. No points: [0]."""
    classes = np.full(len(points), OTHER, np.int8)
    classes[np.isin(points, _SPACES)] = SPACE
    classes[points == ord("\n")] = BREAK
    inner = np.flatnonzero(UNITS[unit][classes[:-1], classes[1:]]) + 1
    return np.concatenate(([0], inner, [len(points)] if len(points) else [])).astype(np.int64)


def fim_transform(docs: DataFrame, how: FillInMiddle = FillInMiddle(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, output, n, form, prefix_chars, middle_chars) for every row.

    n: units of the text; form: psm (prefix, suffix, middle), spm (suffix, prefix, middle) or plain, whose output is the text
    and whose lengths are null. Lengths are in code points. Null texts count as empty, and empty ones are plain; very long
    ones are cut whole, at four bytes a character. A null id draws like an empty one; rows that repeat an id draw alike. No
    rows: no rows; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            keys, texts = batch.columns
            start, size, made = 0, 0, []
            for i in range(len(texts)):
                made.append(how.apply(keys[i].as_py(), texts[i].as_py() or ""))
                size += len(made[-1][0])
                if size >= FLUSH or i == len(texts) - 1:
                    columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)]
                    yield pa.RecordBatch.from_arrays([keys.slice(start, i + 1 - start), *columns], [id_col, "output", "n", "form", "prefix_chars", "middle_chars"])
                    start, size, made = i + 1, 0, []

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{table_key(docs, id_col)}, output string, n long, form string, prefix_chars long, middle_chars long")


def fim_restore(output: Column, form: Column, sentinels: Sequence[str] = FillInMiddle.sentinels) -> Column:
    """The text from output and form. A sentinel occurs once in the output of a cut text, so each splits it in two."""
    p, s, m = (F.lit(x) for x in sentinels)

    def between(first: Column, then: Column | None) -> Column:
        rest = F.split_part(output, first, F.lit(2))
        return rest if then is None else F.split_part(rest, then, F.lit(1))

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
