"""Fast whole-text encoding with a tokenizers file.

Encoding a text equals encoding its pieces wherever the pre-tokenizer always cuts.  For pre-tokenizers that take
runs of letters, and drop white space or let one space start the next word, such places are: before a single space
between two visible characters, before a full stop or comma that follows a Latin letter, and around a single
line feed between two visible characters.  Texts are cut there, each distinct piece is encoded by the library
once per worker, and a text's ids are gathered from its pieces.  A text with any other kind of space between
pieces (doubled, at an end, next to an invisible character) is encoded whole.

New pieces that start and end with a visible character go to the library many at a time, joined by the spaces they start
with.  Where a piece's ids end is told by the bytes that the ids stand for, which are those of the normalized text; where
bytes are missing or ids do not end with the pieces, these pieces are encoded one by one.  Such texts are normalized once,
here, and go to a copy of the tokenizer that does not normalize; those with an added token are left to the whole one.
"""

from __future__ import annotations

import json
import os
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import utf8_views, worker_state

#: Bytes of text encoded at once.
PORTION_BYTES = 4 << 20
#: Pieces remembered per worker; beyond it those that were not asked for again are forgotten, which changes no result.
MEMORY_PIECES = 1_000_000
#: Pieces that the library encodes as one text.
JOINED_PIECES = 64
#: Starts a piece that continues the one before it without a space.
JOINT = "\x01"
#: Starts the memory's key of a piece at the start of a text.
HEAD = "\x02"
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"


def visible(c: str) -> bool:
    return c.isalnum() or "!" <= c <= "~"


def keeps_ascii(rule: dict) -> bool:
    """Whether a normalizer (as its file describes it) leaves every visible character and space of ASCII one byte."""
    kind = rule.get("type")
    if kind == "Sequence":
        return all(map(keeps_ascii, rule["normalizers"]))
    return kind in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or (
        kind == "Replace" and rule["pattern"] == {"Regex": "\\s+"} and rule["content"] == " ")


def spelled(words: pa.Array) -> list[str]:
    """Words without a space as Python strings; a join and a split make them faster than one by one."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_py().split(" ")


def edges(words: pa.Array, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word (``names`` are the same as Python strings) starts and ends with a visible character (or at a joint)."""
    offsets, data = utf8_views(words)
    first = np.zeros(len(words), np.uint8)
    last = np.zeros(len(words), np.uint8)
    full = offsets[1:] > offsets[:-1]
    first[full], last[full] = data[offsets[:-1][full]], data[offsets[1:][full] - 1]
    start = (first > 32) & (first < 127) | (first == 1)
    end = (last > 32) & (last < 127)
    for i in np.flatnonzero(first > 127).tolist():
        start[i] = visible(names[i][0])
    for i in np.flatnonzero(last > 127).tolist():
        end[i] = visible(names[i][-1])
    for i in np.flatnonzero(last == 10).tolist():
        end[i] = names[i] == JOINT + "\n"
    return start, end


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + lengths[i] - 1, for all i in turn."""
    upto = np.cumsum(lengths)
    return np.repeat(starts - upto + lengths, lengths) + np.arange(upto[-1])


class Encoder:
    """ids of whole texts as one flat array with bounds."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        vocabulary = self.tokenizer.get_vocab()
        self.widths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # bytes that an id stands for
        for token, i in vocabulary.items():
            self.widths[i] = len(token.removesuffix(suffix))
        said = self.widths[self.plain([" a b"])[0]].sum()
        self.normalizer = self.tokenizer.normalizer
        if self.normalizer is not None:
            rule = json.loads(self.normalizer.__getstate__())
            self.keeps_ascii, self.lowers = keeps_ascii(rule), '"Lowercase"' in json.dumps(rule)
            self.bare = Tokenizer.from_file(path)  # for normalized texts
            self.bare.normalizer = None
            self.added = [a.content for a in self.tokenizer.get_added_tokens_decoder().values()]
            self.added += [self.normalizer.normalize_str(a) for a in self.added]
        self.space = {4: 1, 2: 0}.get(int(said))  # whether the space before a piece is among its ids' bytes, if that can be told
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.again = np.zeros(0, bool)  # which pieces were asked for again

    def tidy(self) -> None:
        """Forgets the pieces that were not asked for again, or all where that would free less than half."""
        keep = np.flatnonzero(self.again)
        if not len(keep) or len(keep) > MEMORY_PIECES // 2 or len(keep) == len(self.known):
            return self.forget()
        self.known = dict(zip(compress(self.known, self.again.tolist()), range(len(keep)), strict=True))
        self.ids = self.ids[spread(self.starts[keep], self.lengths[keep])]
        self.lengths = self.lengths[keep]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.again = np.zeros(len(keep), bool)

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def normalized(self, text: str) -> str:
        if self.keeps_ascii and text.isascii() and text.isprintable():
            return text.lower() if self.lowers else text
        return self.normalizer.normalize_str(text)

    def joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, lengths, known) of pieces that start with a space and are visible at both ends.  Where ``known`` is
        false, the number of ids could not be told and there are none."""
        n = len(words)
        texts = [" " + " ".join(words[i:i + JOINED_PIECES]) for i in range(0, n, JOINED_PIECES)]
        text = np.arange(n) // JOINED_PIECES
        counts = np.bincount(text)
        lost = np.zeros(len(texts), bool)
        said_words = words
        if self.normalizer is not None:  # ids stand for the bytes of the normalized text
            raw, texts = texts, [self.normalized(t) for t in texts]
            split = [t.split(" ")[1:] for t in texts]
            lost = np.array([len(x) for x in split]) != counts
            lost |= [any(a in r or a in t for a in self.added) for r, t in zip(raw, texts, strict=True)]  # added tokens are told before normalizing
            said_words = list(chain.from_iterable(x if ok else words[i * JOINED_PIECES:(i + 1) * JOINED_PIECES] for i, (x, ok) in enumerate(zip(split, ~lost, strict=True))))
            found = [e.ids for e in self.bare.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            found = self.plain(texts)
        sizes = np.array([len(x) for x in found], np.int64)
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        wide = np.asarray(pc.binary_length(pa.array(said_words, pa.string()))).astype(np.int64) + self.space
        far = 1 + max(int(wide.sum()), int(self.widths[ids].sum()))  # apart the texts, so that no place in one is one in another
        starts = np.arange(n) % JOINED_PIECES == 0
        upto, said = np.cumsum(wide), np.cumsum(self.widths[ids])
        of_id = np.repeat(np.arange(len(texts)), sizes)
        first = np.cumsum(sizes) - sizes
        ends = upto - (upto - wide)[starts][text] + text * far
        places = said - np.concatenate([[0], said])[first][of_id] + of_id * far
        last = np.searchsorted(places, ends)
        right = (last < len(places)) & (places[np.minimum(last, len(places) - 1)] == ends) if len(places) else np.zeros(n, bool)
        lost |= np.bincount(text[~right], minlength=len(texts)) > 0
        lost |= np.bincount(of_id[self.widths[ids] == 0], minlength=len(texts)) > 0
        lost |= last[np.cumsum(counts) - 1] + 1 != first + sizes  # ids never stand for more bytes than there are: if all are there, none is amiss
        known = ~lost[text]
        lengths = np.where(known, last + 1 - np.where(starts, first[text], np.concatenate([[0], last[:-1] + 1])), 0)
        return ids[~lost[of_id]], lengths, known

    def pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, lengths): the ids of piece i are ids[starts[i]:starts[i] + lengths[i]]."""
        n = len(words)
        lengths, starts = np.zeros(n, np.int64), np.zeros(n, np.int64)
        column = pa.array(words, pa.string())
        at, data = utf8_views(column)
        start, end = edges(column, words)
        together = start & end & (data[at[:-1]] > 2) if self.space is not None else np.zeros(n, bool)
        parts, size = [], 0
        some = np.flatnonzero(together)
        if len(some) and self.normalizer is not None and self.keeps_ascii:  # pieces of visible ASCII share texts, since these need no normalizing
            used = data[:at[-1]]
            other = np.logical_or.reduceat((used < 33) | (used > 126), at[:-1])[some]
            some = np.concatenate([some[~other], some[other]])
        if len(some):
            ids, count, known = self.joined([words[i] for i in some.tolist()])
            lengths[some], starts[some] = count, np.cumsum(count) - count
            together[some] = known
            parts, size = [ids], len(ids)
        rest = np.flatnonzero(~together)
        encoded = self.plain([w[1:] if w[0] in (JOINT, HEAD) else " " + w for w in (words[i] for i in rest.tolist())])
        count = np.array([len(e) for e in encoded], np.int64)
        lengths[rest], starts[rest] = count, size + np.cumsum(count) - count
        parts.append(np.fromiter(chain.from_iterable(encoded), np.uint32, int(count.sum())))
        return np.concatenate(parts), starts, lengths

    def places(self, words: list[str]) -> np.ndarray:
        """Index in the memory of each word, none of which is there twice; a word stands for the piece that starts with a
        space, at a joint or, marked as a head, at the start of a text."""
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = at < 0
        self.again[at[~missing]] = True
        if missing.any():
            new = list(compress(words, missing.tolist()))
            if len(self.known) + len(new) > MEMORY_PIECES and self.known:
                self.tidy()
                return self.places(words)
            ids, starts, lengths = self.pieces(new)
            base = len(self.known)
            self.starts = np.concatenate([self.starts, len(self.ids) + starts])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, ids])
            self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
            self.known.update(zip(new, range(base, base + len(new)), strict=True))
            at[missing] = base + np.arange(len(new))
        return at

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of text i are ids[bounds[i]:bounds[i + 1]]."""
        n = len(column)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        at, data = utf8_views(column)
        data = data[at[0]:at[-1]]
        if (data <= 2).any():
            own_marks = pc.match_substring_regex(column, f"[{JOINT}{HEAD}]").to_numpy(zero_copy_only=False)
        else:
            own_marks = np.zeros(n, bool)
        marked = pc.replace_substring_regex(column, f"([{LATIN}])([.,])", rf"\1 {JOINT}\2")
        if (data == 10).any():
            marked = pc.replace_substring_regex(marked, f"([!-~{LATIN}])\n([!-~{LATIN}])", f"\\1 {JOINT}\n {JOINT}\\2")
        words = pc.split_pattern(marked, " ")
        offsets = words.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = words.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        distinct = spelled(coded.dictionary)
        good_start, good_end = edges(coded.dictionary, distinct)
        bad = np.zeros(len(codes), bool)
        bad[1:] = ~(good_end[codes[:-1]] & good_start[codes[1:]])
        bad[offsets[:-1]] = False
        whole = (np.add.reduceat(bad, offsets[:-1]) > 0) | own_marks
        used = np.ones(len(codes), bool)
        if whole.any():
            used = ~np.repeat(whole, np.diff(offsets))
        inner = used.copy()
        inner[offsets[:-1]] = False
        wanted = np.zeros(len(distinct), bool)
        wanted[codes[inner]] = True
        wanted = np.flatnonzero(wanted)
        heads = offsets[:-1][~whole]
        first, of_head = np.unique(codes[heads], return_inverse=True)
        # One call, so that the memory cannot start anew in between.
        at = self.places([distinct[i] for i in wanted.tolist()] + [HEAD + distinct[i] for i in first.tolist()])
        place = np.zeros(len(distinct), np.int64)
        place[wanted] = at[:len(wanted)]
        piece = place[codes]
        piece[heads] = at[len(wanted):][of_head]
        piece = piece[used]
        lengths = self.lengths[piece] if len(piece) else np.zeros(0, np.int64)
        before = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[spread(self.starts[piece], lengths)] if len(piece) else self.ids[:0]
        upto = np.concatenate([[0], np.cumsum(np.where(whole, 0, np.diff(offsets)))])
        bounds = before[upto]
        if not whole.any():
            return ids, bounds
        late = np.flatnonzero(whole).tolist()
        encoded = dict(zip(late, self.plain([column[i].as_py() for i in late]), strict=True))
        parts = [np.array(encoded[i], np.uint32) if i in encoded else ids[bounds[i]:bounds[i + 1]] for i in range(n)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def encoded(encode, column: pa.Array, limit: int = PORTION_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds) of a column that is encoded some texts at a time, which bounds what the encoder holds."""
    upto = np.cumsum(np.asarray(pc.binary_length(column)).astype(np.int64))
    cuts = np.flatnonzero(np.diff(upto // limit, append=-1)) + 1 if len(upto) else np.zeros(0, np.int64)
    parts = [encode(column.slice(a, z - a)) for a, z in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)] if len(cuts) else [encode(column)]
    sizes = np.concatenate([np.diff(b) for _, b in parts])
    return np.concatenate([ids for ids, _ in parts]), np.concatenate([[0], np.cumsum(sizes)])


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return worker_state(f"encoder:{path}", lambda: Encoder(path))
