"""Words of texts grouped as whole numbers, in Arrow batches: no word takes a row of its own.

`pack_words` turns the words of each text into its distinct words, joined, with their positions; that
is what moves to the tasks. `term_groups` and `field_groups` work on the texts of one part, which are few
megabytes: each distinct word is folded and looked up once for the part, not once for each text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from foliary.functions.text import FOLD_FROM, FOLD_TO, FOLD_WIDE, MAX_TOKEN_CHARS

#: Joins the terms of a row; no word has it. Terms of a dictionary that do are kept as a list.
SEPARATOR = "\n"
_FOLD = str.maketrans(dict(zip(FOLD_FROM, FOLD_TO, strict=True)) | FOLD_WIDE)
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(x: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _rotated(x + word * _P2, 31) * _P1


def xxhash64(values: pa.Array) -> np.ndarray:
    """What the SQL function of that name gives for texts (its seed is 42), one length after the other."""
    raw = values.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    sizes, out = np.diff(ends), np.zeros(len(raw), np.uint64)
    for size in np.unique(sizes):
        rows = np.nonzero(sizes == size)[0]
        own = data[ends[rows][:, None] + np.arange(size)]
        words = np.ascontiguousarray(own[:, : size // 8 * 8]).view("<u8")
        hashed, at = np.full(len(rows), 42, np.uint64), 0
        if size >= 32:
            lanes = [hashed + _P1 + _P2, hashed + _P2, hashed, hashed - _P1]
            while at + 4 <= words.shape[1]:
                lanes = [_round(lane, words[:, at + i]) for i, lane in enumerate(lanes)]
                at += 4
            hashed = sum(_rotated(lane, by) for lane, by in zip(lanes, (1, 7, 12, 18), strict=True))
            for lane in lanes:
                hashed = (hashed ^ _round(np.zeros_like(lane), lane)) * _P1 + _P4
        else:
            hashed = hashed + _P5
        hashed = hashed + np.uint64(size)
        for i in range(at, words.shape[1]):
            hashed = _rotated(hashed ^ _round(np.zeros_like(hashed), words[:, i]), 27) * _P1 + _P4
        rest = size // 8 * 8
        if rest + 4 <= size:
            half = np.ascontiguousarray(own[:, rest : rest + 4]).view("<u4")[:, 0].astype(np.uint64)
            hashed, rest = _rotated(hashed ^ (half * _P1), 23) * _P2 + _P3, rest + 4
        for i in range(rest, size):
            hashed = _rotated(hashed ^ (own[:, i].astype(np.uint64) * _P5), 11) * _P1
        hashed = (hashed ^ (hashed >> np.uint64(33))) * _P2
        hashed = (hashed ^ (hashed >> np.uint64(29))) * _P3
        out[rows] = hashed ^ (hashed >> np.uint64(32))
    return out.view(np.int64)


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)


def _ints(values: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
    return pa.array(values.astype(np.int32), mask=none)


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys, equal ones as they come, and where each distinct key begins in it.

    Keys and their places share one number, which sorts faster than the places alone.
    """
    bits = max(len(keys), 1).bit_length()
    if int(keys.max(initial=0)) >> (62 - bits):
        order = np.argsort(keys, kind="stable")
        both = keys[order]
    else:
        both = np.sort((keys << bits) | np.arange(len(keys)))
        order, both = both & ((1 << bits) - 1), both >> bits
    return order, np.nonzero(np.r_[len(both) > 0, both[1:] != both[:-1]])[0]


def _slices(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of slices of an array, one slice after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - before, sizes)


def _kept(names: pa.Array, stopwords: tuple[str, ...]) -> np.ndarray:
    found = pc.is_in(names, value_set=pa.array(stopwords, pa.string()))
    return ~found.to_numpy(zero_copy_only=False)


def cut_words(lists: pa.Array) -> pa.Array:
    """Lists of words in which those over MAX_TOKEN_CHARS characters, which are rare, are cut."""
    if (pc.max(pc.binary_length(lists.flatten())).as_py() or 0) <= MAX_TOKEN_CHARS:
        return lists
    size = MAX_TOKEN_CHARS
    cut = [x and [w[i : i + size] for w in x for i in range(0, len(w), size)] for x in lists.to_pylist()]
    return pa.array(cut, lists.type)


def pack_words(batches: Iterator[pa.RecordBatch], stopwords: tuple[str, ...], positions: bool) -> Iterator[pa.RecordBatch]:
    """(sha256, dl, kept_dl, words, tfs and places) of each text with words (sha256, words), those uncut.

    The distinct words of a text come in the order in which they appear first; `dl` and `kept_dl` count
    its words, with and without stop words. Places are those of the first word, then of the second.
    """
    for batch in batches:
        lists = cut_words(batch.column("words"))
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        hashes, sizes = batch.column("sha256").filter(pa.array(sizes > 0)), sizes[sizes > 0]
        if not len(sizes):
            continue
        coded = lists.flatten().dictionary_encode()
        names, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        text = np.repeat(np.arange(len(sizes)), sizes)
        order, first = _sorted(text * len(names) + codes)
        # The place of a word's first copy also orders the words of a text, and the texts.
        tf, again = np.diff(np.r_[first, len(order)]), np.argsort(order[first])
        first, tf = first[again], tf[again]
        seen = order[first]
        distinct = np.bincount(text[seen], minlength=len(sizes))
        kept = np.bincount(text, _kept(names, stopwords)[codes], len(sizes))
        listed = _lists(distinct, names.take(pa.array(codes[seen])))
        columns = [hashes, _ints(sizes), _ints(kept), pc.binary_join(listed, SEPARATOR), _lists(distinct, _ints(tf))]
        if positions:
            place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            columns.append(_lists(sizes, _ints(place[order[_slices(first, tf)]])))
        shown = ["sha256", "dl", "kept_dl", "words", "tfs", "places"]
        yield pa.RecordBatch.from_arrays(columns, names=shown[: len(columns)])


def asked_words(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(part, word): the distinct words of the texts of each part in a batch of packed rows.

    `known` has a bit for each of a fixed number of slots, set where a dictionary has a word of that hash;
    most words that it lacks are not asked for.
    """
    for batch in batches:
        if batch.num_rows:
            parts, at = np.unique(batch.column("part").to_numpy(), return_inverse=True)
            lists = pc.split_pattern(batch.column("words"), SEPARATOR)
            coded = lists.flatten().dictionary_encode()
            names, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            slot = xxhash64(names) & (8 * len(known) - 1)
            likely = (known[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
            text, picked = np.repeat(at, pc.list_value_length(lists).to_numpy()), likely[codes]
            both = np.unique(text[picked] * len(names) + codes[picked])
            words = names.take(pa.array(both % len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(parts[both // len(names)]), words], names=["part", "word"])


def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word): the distinct words of a batch of texts (words), those uncut."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([cut_words(batch.column("words")).flatten().unique()], names=["word"])


class _Part:
    """The words of the packed texts of a part, in numbers.

    `row` is the text of an entry, `code` its word, `tf` its copies; terms are the words themselves, then
    folded forms and lemmas that differ: `folded` has the term of each word, `lemmas` begin at
    `lemma_at` and are `lemma_count`. `own` tells words that the dictionary lacks.
    """

    def __init__(self, texts: pa.Table, found: pa.Table, stopwords: tuple[str, ...]):
        lists = pc.split_pattern(texts["words"].combine_chunks(), SEPARATOR)
        sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        names, self.code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.copies = texts["copies"].to_numpy().astype(np.int64)
        self.tf = texts["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
        self.kept = _kept(names, stopwords)[self.code]
        # The first word, and the first that is kept, open the fields of a text.
        self.opening = np.zeros(len(self.row), bool)
        self.opening[np.cumsum(sizes) - sizes] = True
        kept = np.nonzero(self.kept)[0]
        self.kept_opening = np.zeros(len(self.row), bool)
        self.kept_opening[kept[np.nonzero(np.diff(self.row[kept], prepend=-1))[0]]] = True

        odd = np.nonzero(~pc.string_is_ascii(names).to_numpy(zero_copy_only=False))[0]
        plain = [x.translate(_FOLD) for x in names.take(pa.array(odd)).to_pylist()]
        entry = pc.index_in(names, value_set=found["word"].combine_chunks().cast(pa.string()))
        self.own = entry.is_null().to_numpy(zero_copy_only=False)
        lemmas = found["_lemmas"].combine_chunks()
        terms = pa.concat_arrays([names, pa.array(plain, pa.string()), lemmas.flatten().cast(pa.string())]).dictionary_encode()
        codes = terms.indices.to_numpy().astype(np.int64)
        self.terms, self.folded = terms.dictionary, np.arange(len(names))
        self.folded[odd] = codes[len(names) : len(names) + len(odd)]
        self.lemmas = codes[len(names) + len(odd) :]
        count = pc.list_value_length(lemmas).to_numpy().astype(np.int64)
        entry = entry.fill_null(0).to_numpy().astype(np.int64)
        self.lemma_count = np.where(self.own, 0, count[entry] if len(count) else 0)
        self.lemma_at = (np.cumsum(count) - count)[entry] if len(count) else np.zeros(len(names), np.int64)

    def of_lemmas(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kept entries whose words the dictionary has: the entry, the lemma's term, whether it is the first."""
        some = np.nonzero(self.kept & ~self.own[self.code])[0]
        count, at = self.lemma_count[self.code[some]], self.lemma_at[self.code[some]]
        place = _slices(at, count)
        return np.repeat(some, count), self.lemmas[place], place == np.repeat(at, count)


def _documents(texts: pa.Table, *columns: str) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of its document (its hash, and these counts), and a text of each document."""
    key = pc.dictionary_encode(texts["sha256"].combine_chunks(), null_encoding="encode").indices.to_numpy().astype(np.int64)
    for column in columns:
        values = texts[column].to_numpy().astype(np.int64)
        key = np.unique(key, return_inverse=True)[1] * (int(values.max(initial=0)) + 1) + values
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    return inverse, first


def _added(values: np.ndarray, order: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values[order], start) if len(start) else np.zeros(0, np.int64)


def term_groups(texts: pa.Table, found: pa.Table, stopwords: tuple[str, ...], buckets: int | None, positions: bool) -> pa.Table:
    """The term rows (see `analyze.term_rows`) of the content of the texts of a part, packed if `buckets` are given.

    `found` are the dictionary's entries (word, _lemmas) for words of the part.
    """
    part = _Part(texts, found, stopwords)
    document, of = _documents(texts, "dl", "kept_dl")
    row, code = part.row, part.code
    odd = np.nonzero(part.folded[code] != code)[0]
    entry, lemma, leading = part.of_lemmas()
    # A word is a term of its own, with the fields that have it as it is; then folded forms, then lemmas.
    source = np.concatenate([np.arange(len(row)), odd, entry])
    term = np.concatenate([code, part.folded[code[odd]], lemma])
    none, some = np.zeros(len(odd), bool), np.ones(len(entry), bool)
    fields = [
        np.concatenate([np.ones(len(row), bool), none, ~some]),
        np.concatenate([part.kept & part.own[code], none, some]),
        np.concatenate([part.folded[code] == code, ~none, ~some]),
    ]
    leads = part.kept_opening[source] & np.concatenate([np.ones(len(row), bool), ~none, leading])
    begins = [part.opening[source], leads, part.opening[source]]
    opens = sum((inside & at).astype(np.int64) << i for i, (inside, at) in enumerate(zip(fields, begins, strict=True)))

    rank = np.empty(len(part.terms), np.int64)
    rank[pc.array_sort_indices(part.terms).to_numpy()] = np.arange(len(part.terms))
    group = document[row[source]]
    if buckets is not None:
        group = group * buckets + (xxhash64(part.terms) % buckets)[term]
    order, start = _sorted(group * len(part.terms) + rank[term])
    tf = (part.tf * part.copies[row])[source]
    sums = [_added(np.where(inside, tf, 0), order, start) for inside in fields]
    opens = np.bitwise_or.reduceat(opens[order], start) if len(start) else np.zeros(0, np.int64)
    head = order[start]
    names = [*[f"tf_{i}" for i in range(4)], "opens"]
    if buckets is None:
        counts = [*[pa.array(x, pa.int64(), mask=x == 0) for x in sums], pa.nulls(len(head), pa.int64())]
        shown = texts.select(["sha256", "dl", "kept_dl"]).take(pa.array(of[group[head]]))
        columns = [part.terms.take(pa.array(term[head])), *shown.columns, *counts, _ints(opens)]
        names = ["term", *shown.column_names, *names]
        if positions:
            places = texts["places"].combine_chunks().flatten().to_numpy()
            where = np.empty(len(order), np.int64)
            where[order] = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(order)]))
            lists = [_places(part, places, source[inside], where[inside], len(start)) for inside in fields]
            lists.append(_lists(np.zeros(len(start), np.int64), _ints(np.zeros(0))))
            columns.append(pa.StructArray.from_arrays(lists, [f"p{i}" for i in range(4)]))
            names.append("positions")
        return pa.table(columns, names=names)
    first = np.nonzero(np.diff(group[head], prepend=-1))[0]
    sizes = np.diff(np.r_[first, len(head)])
    shown = texts.select(["sha256", "dl", "kept_dl"]).take(pa.array(of[group[head[first]] // buckets]))
    counts = [*[_ints(x, x == 0) for x in sums], pa.nulls(len(head), pa.int32()), _ints(opens)]
    joined = _joined(part.terms, term[head], sizes)
    columns = [*shown.columns, _ints(group[head[first]] % buckets), joined, *[_lists(sizes, c) for c in counts]]
    return pa.table(columns, names=[*shown.column_names, "bucket", "term", *names])


def _joined(terms: pa.Array, picked: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Terms of each row as one text: joined, or, after a separator, as JSON if a lemma is empty or has one."""
    listed = _lists(sizes, terms.take(pa.array(picked)))
    joined = pc.binary_join(listed, SEPARATOR)
    broken = pc.or_(pc.match_substring(terms, SEPARATOR), pc.equal(terms, "")).to_numpy(zero_copy_only=False)
    rows = np.unique(np.repeat(np.arange(len(sizes)), sizes)[broken[picked]]) if broken.any() else np.zeros(0, int)
    if not len(rows):
        return joined
    texts = joined.to_pylist()
    for row in rows:
        texts[row] = SEPARATOR + json.dumps(listed[row].as_py(), ensure_ascii=False)
    return pa.array(texts, pa.string())


def _places(part: _Part, places: np.ndarray, source: np.ndarray, group: np.ndarray, groups: int) -> pa.Array:
    """The sorted positions of each group's entries, those of copies as often as there are copies."""
    sizes = part.tf[source]
    found = places[_slices((np.cumsum(part.tf) - part.tf)[source], sizes)].astype(np.int64)
    both = np.sort(np.repeat((np.repeat(group, sizes) << 32) | found, np.repeat(part.copies[part.row[source]], sizes)))
    return _lists(np.bincount(both >> 32, minlength=groups), _ints(both & 0xFFFFFFFF))


def field_groups(texts: pa.Table, found: pa.Table, stopwords: tuple[str, ...], names: tuple[str, ...]) -> pa.Table:
    """(sha256, field, terms): the positions and terms of the content of a part, a row for a document and field.

    `names` are those of the fields: words, lemmas of words that are kept, folded words.
    """
    part = _Part(texts, found, stopwords)
    document, of = _documents(texts)
    places = texts["places"].combine_chunks().flatten().to_numpy()
    every = np.arange(len(part.row))
    own = np.nonzero(part.kept & part.own[part.code])[0]
    entry, lemma, _ = part.of_lemmas()
    entries = [
        (every, part.code),
        (np.concatenate([own, entry]), np.concatenate([part.code[own], lemma])),
        (every, part.folded[part.code]),
    ]
    out = []
    for name, (source, term) in zip(names, entries, strict=True):
        sizes = part.tf[source]
        copies = np.repeat(part.copies[part.row[source]], sizes)
        place = np.repeat(places[_slices((np.cumsum(part.tf) - part.tf)[source], sizes)], copies).astype(np.int64)
        whose = np.repeat(np.repeat(document[part.row[source]], sizes), copies)
        order, _ = _sorted((whose << 31) | place)
        term = np.repeat(np.repeat(term, sizes), copies)[order]
        count = np.bincount(whose, minlength=len(of))
        some = np.nonzero(count)[0]
        pairs = pa.StructArray.from_arrays([_ints(place[order]), part.terms.take(pa.array(term))], ["pos", "term"])
        sha256 = texts["sha256"].combine_chunks().take(pa.array(of[some]))
        out.append(pa.table([sha256, pa.repeat(name, len(some)), _lists(count[some], pairs)], names=["sha256", "field", "terms"]))
    return pa.concat_tables(out)
