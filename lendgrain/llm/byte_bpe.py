"""Token ids by the tokenizers library, with a bounded memory of what it answered before.

A byte-level vocabulary without a normaliser never makes a token across the start of a blank that a letter, digit
or other ASCII sign follows, as its splitting rule begins a new part there whatever stands before or after. So a
text is cut at such blanks, each piece not met yet is encoded by the library, and the answers are put together.
Pieces of common signs are split by the vocabulary's own rule and their parts given to the library's model, some at a
time with a sign between them that no text has and no merge touches; others go to the library as they are. Texts with pieces that begin otherwise (runs of blanks, control characters, rarer
signs), and all texts of a vocabulary of another kind, go to the library whole.
"""

import hashlib
import json
import os
from array import array
from itertools import accumulate, chain

import numpy as np
import regex

from lendgrain.llm.shared import kept

KEPT_PIECES = 1_000_000
PARTS_A_CALL = 32
PIECES_AT_ONCE = 20_000
KEPT_MARKS = 100_000
TEXT_BLOCK = 1 << 22
# The splitting rule of byte-level vocabularies (fixed value). For signs below COMMON the classes of letters, numbers and
# blanks here are the library's; beyond, Unicode versions differ.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
COMMON = "\u0500"
NO_TEXT = [0xC0, 0xC1, *range(0xF5, 0x100)]  # bytes that UTF-8 never has
WHOLE = 0  # instead of an answer: a text with this piece goes to the library whole
FIRST = frozenset(map(chr, [*range(0x21, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x180)]))


class Known(dict):
    """Answers by piece. What is not there is noted in `wanted`, in order, and None for now."""

    def __missing__(self, piece):
        self.wanted.append(piece)


class TokenEncoder:
    def __init__(self, vocabulary: str, most=KEPT_PIECES):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core already
        self.library, self.most = Tokenizer.from_str(vocabulary), most
        self.model, self.signs = self.library.model, byte_signs()
        self.sign_of = np.array([self.signs[b] for b in range(256)], "<u4")
        self.first, self.after = Known(), Known()  # answers for pieces at a text's start, and for those after a blank
        self.marks = {}  # and for the parts of pieces, but for their first words
        kind = json.loads(vocabulary)
        split, model = kind.get("pre_tokenizer") or {}, kind["model"]
        plain = kind.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.in_pieces = plain and model.get("type") == "BPE" and not model.get("dropout") and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in kind["added_tokens"])
        self.between = self.free_byte(model) if self.in_pieces else None
        self.added = any(not a["content"].startswith("<|") for a in kind["added_tokens"])
        size = 1 + max([*model["vocab"].values(), *(a["id"] for a in kind["added_tokens"])])
        self.code, self.kind = ("H", "<u2") if size <= 1 << 16 else ("I", "<u4")

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, without special tokens put around it."""
        return [np.frombuffer(x, self.kind) for x in self.encode_bytes(texts)]

    def encode_bytes(self, texts: list[str | None], end: bytes = b"") -> list[bytes]:
        """The same as bytes, with an end put after each."""
        out = []
        for block in blocks([t or "" for t in texts]):
            if not self.in_pieces:
                out += [np.array(ids, self.kind).tobytes() + end for ids in self.asked(block)]
                continue
            cut = [t.split(" ") for t in block]
            heads = [c.pop(0) for c in cut]
            first, self.first = self.answers(self.first, [heads], "")
            after, self.after = self.answers(self.after, cut, " ")
            for text, head, answers in zip(block, first[0], after):
                try:
                    out.append(b"".join((head, *answers, end)))
                except TypeError:  # a piece that has no answer of its own
                    out.append(np.array(self.asked([text])[0], self.kind).tobytes() + end)
        return out

    def asked(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def answers(self, known: Known, rows: list[list[str]], before: str) -> tuple[list[list], Known]:
        """The answer for every piece of the rows (WHOLE for one that cannot stand alone after a blank), and the memory."""
        known.wanted = wanted = []
        out = [list(map(known.__getitem__, pieces)) for pieces in rows]
        if wanted:
            new = set(wanted)
            if len(known) + len(new) > self.most:  # keep what these rows need
                known = Known((p, known[p]) for p in set().union(*rows) - new)
            fresh = self.learned(known, new, before)
            known.update(fresh)
            found = map(fresh.__getitem__, wanted)
            for answers in out:
                at = -1
                for _ in range(answers.count(None)):
                    at = answers.index(None, at + 1)
                    answers[at] = next(found)
            known.wanted = []
        return out, known

    def learned(self, known: Known, new: set, before: str) -> dict:
        """Answers for new pieces."""
        fresh, marked, rest = {}, [], []
        words = [] if self.added else [p for p in new if p.isascii() and p.isalpha()]
        for p in new.difference(words):
            if before and p[:1] not in FIRST:
                fresh[p] = WHOLE
            elif self.added or "<|" in p or not p.isascii() and max(p) >= COMMON:
                rest.append(p)
            else:
                (words if p.isalpha() else marked).append(p)
        for i in range(0, len(words), PIECES_AT_ONCE):  # these first, as they are parts of the marked ones
            part = words[i:i + PIECES_AT_ONCE]
            fresh.update(zip(part, self.modelled([before + p for p in part])))
        for i in range(0, len(marked), PIECES_AT_ONCE):
            fresh.update(self.by_parts(known, fresh, marked[i:i + PIECES_AT_ONCE], before))
        for i in range(0, len(rest), PIECES_AT_ONCE):
            part = rest[i:i + PIECES_AT_ONCE]
            fresh.update((p, array(self.code, ids).tobytes()) for p, ids in zip(part, self.asked([before + p for p in part])))
        return fresh

    def by_parts(self, known: Known, fresh: dict, pieces: list[str], before: str):
        """The answers for pieces of common signs, part by part; a part that is a known piece itself is not asked for."""
        if before:  # the pieces begin where a part begins with a blank
            flat = PARTS.findall(before + before.join(pieces))
            starts = [i for i, part in enumerate(flat) if part[0] == " "]
        else:
            cut = [PARTS.findall(p) for p in pieces]
            flat, starts = list(chain.from_iterable(cut)), list(accumulate(map(len, cut), initial=0))[:-1]
        parts = dict.fromkeys(flat)
        for part in parts:
            parts[part] = fresh.get(part[1:]) or known.get(part[1:]) if before and part[0] == " " else self.marks.get(part)
        unknown = [part for part, answer in parts.items() if not answer]
        parts.update(zip(unknown, self.modelled(unknown)))
        if len(self.marks) > KEPT_MARKS:
            self.marks = {}
        self.marks.update((part, parts[part]) for part in unknown if part[0] != " ")
        answers = list(map(parts.__getitem__, flat))
        return zip(pieces, [b"".join(answers[a:b]) for a, b in zip(starts, [*starts[1:], len(flat)])], strict=True)

    def free_byte(self, model: dict) -> int | None:
        """A byte that no text has and whose sign no merge touches: with it between them, parts are merged as if each stood
        alone. None where the model looks at a part as a whole, or marks its start or end."""
        if model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            return None
        merged = set().union(*map("".join, model["merges"]))
        return next((b for b in NO_TEXT if chr(self.signs[b]) not in merged and chr(self.signs[b]) in model["vocab"]), None)

    def modelled(self, parts: list[str]) -> list[bytes]:
        """The ids that the library's model gives for each part."""
        tokenize = self.model.tokenize
        if self.between is None:
            return [array(self.code, [t.id for t in tokenize(p.encode().decode("latin-1").translate(self.signs))]).tobytes() for p in parts]
        if not parts:
            return []
        between, ids = chr(self.signs[self.between]), []
        signs = self.sign_of[np.frombuffer(bytes([self.between]).join(map(str.encode, parts)), np.uint8)].tobytes().decode("utf-32-le").split(between)
        for at in range(0, len(signs), PARTS_A_CALL):
            ids += [t.id for t in tokenize(between.join(signs[at:at + PARTS_A_CALL]) + between)]
        ids = np.array(ids, self.kind)
        ends = np.flatnonzero(ids == self.library.token_to_id(between)) * ids.itemsize
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *(ends[:-1] + ids.itemsize).tolist()], ends.tolist())]


def byte_signs() -> dict[int, int]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if it prints, else the next beyond 255."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printed]
    return {b: b for b in printed} | {b: 256 + i for i, b in enumerate(rest)}


def blocks(texts):
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size > TEXT_BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def worker_encoder(path: str):
    """The vocabulary travels with the function; each Python worker loads it once."""
    with open(path, encoding="utf-8") as f:
        vocabulary = f.read()
    name = "tokens_" + hashlib.sha256(vocabulary.encode()).hexdigest()
    return lambda: kept(name, lambda: TokenEncoder(vocabulary))
