"""Token counts of texts: pre-tokens proven to be one token are looked up, only the rest are merged."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spendtrail.llm.common import table_key
from spendtrail.llm.packing import BYTE_NAMES

KEPT = 400_000  # merged pre-tokens that a task remembers
LONG = 64  # characters; longer pre-tokens aren't remembered
BLOCK = 1 << 20  # characters of a text whose pre-tokens are held at a time, about

_NAMED = {name: byte for byte, name in BYTE_NAMES.items()}
WHITE = re.compile(r"[ \t\n\r]+")
#: Characters whose classes, case and composition are the same to every library: ASCII without controls, Latin letters up to U+017F.
ODD = re.compile(r"[^\t\n\r -~¡-¬®-įı-ňŊ-ž]")
#: The normaliser under which such characters are lowered and nothing else happens to them.
LOWERED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}


def name_of(text: str) -> str:
    """The pre-token as a byte-level model spells it."""
    return text if text.isascii() and text.isalpha() else text.encode().decode("latin-1").translate(BYTE_NAMES)


def text_of(name: str) -> str | None:
    """What is spelt so; None if these bytes are no whole characters."""
    try:
        return name.translate(_NAMED).encode("latin-1").decode()
    except UnicodeError:
        return None


@lru_cache(maxsize=2)
def _tokenizer(file: str) -> Tokenizer:
    return Tokenizer.from_file(file)


@lru_cache(maxsize=2)
def whole_tokens(file: str) -> frozenset[str]:
    """Vocabulary strings that encode alone as the one token which they name: proven by encoding each of them once.

    At most one string a vocabulary entry, so the set's size is bounded by the tokenizer's.
    """
    tokenizer = _tokenizer(file)
    suffix = json.loads(tokenizer.to_str())["model"].get("end_of_word_suffix") or ""
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    found = set()
    for name, number in tokenizer.get_vocab(with_added_tokens=False).items():
        text = text_of(name.removesuffix(suffix)) if name.endswith(suffix) else None
        if text and text not in special and tokenizer.encode(text, add_special_tokens=False).ids == [number]:
            found.add(text)
    return frozenset(found)


class Counts(dict):
    """Pre-token -> number of tokens: 1 for whole tokens, the merged length for the rest, as they come up."""

    def __init__(self, file: str, whole: frozenset[str]):
        tokenizer = _tokenizer(file)
        self.model, self.normalizer, self.pre = tokenizer.model, tokenizer.normalizer, tokenizer.pre_tokenizer
        told = json.loads(tokenizer.to_str())
        added = tokenizer.get_added_tokens_decoder().values()
        steps = (told["pre_tokenizer"] or {}).get("pretokenizers", [told["pre_tokenizer"]])
        if told["model"]["type"] != "BPE" or not steps or (steps[-1] or {}).get("type") != "ByteLevel" or steps[-1]["add_prefix_space"] or any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("counts are for byte-level BPE tokenizers whose added tokens are matched as they are")
        self.special = re.compile("|".join(re.escape(t.content) for t in sorted(added, key=lambda t: -len(t.content))) or r"(?!)")
        self.find = None
        split = steps[0]
        if len(steps) == 2 and split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"] and not steps[1]["use_regex"] and told["normalizer"] == LOWERED and "Regex" in split["pattern"] and "(?" not in split["pattern"]["Regex"]:
            self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.whole = dict.fromkeys(whole, 1)
        self.update(self.whole)

    def __missing__(self, pre_token: str) -> int:
        n = len(self.model.tokenize(name_of(pre_token)))
        if len(pre_token) <= LONG:
            if len(self) > len(self.whole) + KEPT:
                self.clear()
                self.update(self.whole)
            self[pre_token] = n
        return n

    def of(self, text: str) -> int:
        if not self.special.search(text):
            return self.plain(text)
        return sum(map(self.plain, self.special.split(text))) + len(self.special.findall(text))

    def plain(self, text: str) -> int:
        """Tokens of a text without added ones. Matches never reach over white space where it is removed, so such texts are read
        in blocks, and words with characters that libraries may class differently go to the tokenizer's own steps."""
        if self.find is None:
            return self.stepwise(text)
        total, at = 0, 0
        while at < len(text):
            end = WHITE.search(text, at + BLOCK) if len(text) - at > BLOCK else None
            block = text[at : end.start()] if end else text[at:]
            at = end.end() if end else len(text)
            if ODD.search(block):
                words = WHITE.split(block)
                odd = [w for w in words if ODD.search(w)]
                total += sum(map(self.stepwise, odd))
                block = " ".join([w for w in words if not ODD.search(w)])
            total += sum(map(self.__getitem__, self.find(block.lower())))
        return total

    def stepwise(self, text: str) -> int:
        text = self.normalizer.normalize_str(text) if self.normalizer else text
        return sum(self[text_of(name)] for name, _ in self.pre.pre_tokenize_str(text))


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row, tokens as the tokenizers library counts them for the whole text.

    No begin or end tokens; added tokens found in a text are one token each, as by default in the library; n_bytes is in
    UTF-8; over_limit says whether there are more than ``limit`` tokens. Which vocabulary strings are whole tokens is proven
    once, on the driver; that set goes to the tasks. Null texts count as empty: 0 bytes, 0 tokens. Very long texts are
    counted whole. Repeated rows each keep their row; no rows: no rows; other columns are ignored. For byte-level BPE models
    (others are refused); ``tokenizer_file`` must be at that path on every executor.
    """
    whole = whole_tokens(tokenizer_file)

    def run(batches):
        counts = Counts(tokenizer_file, whole)  # goes with the task, as workers outlive it
        for batch in batches:
            keys, texts = batch.columns
            found = [(len(t.encode()), counts.of(t)) for t in (t.as_py() or "" for t in texts)]
            sizes, numbers = zip(*found, strict=True) if found else ((), ())
            columns = [pa.array(sizes, pa.int64()), pa.array(numbers, pa.int64()), pa.array([n > limit for n in numbers], pa.bool_())]
            yield pa.RecordBatch.from_arrays([keys, *columns], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{table_key(docs, id_col)}, n_bytes long, n_tokens long, over_limit boolean")
