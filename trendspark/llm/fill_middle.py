"""Fill-in-middle: a text is cut into prefix, middle and suffix between its units, and rearranged.

The cut is found by repeated captures: one ``regex`` match of ``(unit)*`` over the whole text keeps
every repetition, so ``match.ends(1)`` holds where each unit ends; its length is the number of
units, and both cuts are looked up in it. The unit is possessive, so the match runs once from left
to right, without steps back.

All choices come from the id and the seed alone: the first four groups of 8 hexadecimal digits of
sha256(``seed:doc_id``). h1 and h2, each modulo (units + 1), give the two cuts; h3 decides whether the
text is rearranged at all, h4 the order:

    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle
    plain  the text itself

A text that holds one of the three markers stays plain, so the markers of an output tell its parts
apart, and ``restored`` gives the exact text back from output and form.

Scale: a map over rows without shuffle; a task holds one Arrow batch and its outputs, in pieces of
about CHUNK_BYTES bytes.

Results: null and empty texts are the empty text, 0 units, plain. A null id is hashed as the empty
string (``seed:``). A text without a line end is one unit. Equal rows give equal rows; equal texts with
other ids are cut elsewhere. Very long texts are matched whole, one offset of 8 bytes or so a unit.
Empty tables give empty tables. ``rearranged`` keeps no other columns than the id, so extra columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame

from trendspark.llm.common import byte_texts

LINE = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 7, 100, 50
CHUNK_BYTES = 4_000_000
COLUMNS = "doc_id long, text string, n long, form string, prefix_chars long, middle_chars long, output string"


def compiled(unit: str = LINE):
    """The pattern of whole texts: units one after the other, each a capture of group 1."""
    import regex

    return regex.compile(f"((?>{unit}))*+", regex.DOTALL)


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]


def cut(pattern, text: str, doc_id: int | None, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple:
    """(n, form, prefix length, middle length, output) of one text; lengths are None if plain.

    ``rate`` and ``spm`` are percents of texts to rearrange, and of these to put in the order spm.
    Raises ValueError where the units don't cover the text.
    """
    match = pattern.fullmatch(text)
    if match is None:
        raise ValueError("the units do not cover the text")
    ends = match.ends(1)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that ``cut`` made ``output`` of, read from the output's own markers."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    rest, _, middle = output.rpartition(MIDDLE) if output.count(MIDDLE) == 1 else ("", "", None)
    if middle is None or not rest.startswith(first):
        raise ValueError("not an output of this form")
    one, found, two = rest[len(first) :].partition(second)
    if not found:
        raise ValueError("not an output of this form")
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def rearranged(docs: DataFrame, unit: str = LINE, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output) for each row of ``docs`` (doc_id, text)."""

    def run(batches):
        import pyarrow as pa

        pattern = compiled(unit)
        kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, whole in byte_texts(batch.column("text"), CHUNK_BYTES):
                own, texts = ids[a : a + len(whole)], [t.decode() for t in whole]
                rows = [cut(pattern, t, i, seed, rate, spm) for i, t in zip(own, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((own, texts, *zip(*rows, strict=True)), kinds, strict=True)], schema=kinds)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, COLUMNS)


def digests(docs: DataFrame) -> DataFrame:
    """The cuts of ``rearranged`` with the hashes of the output and of the text rebuilt from it;
    texts and outputs stay in the Python worker."""

    def run(batches):
        import pyarrow as pa

        pattern = compiled()
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for a, whole in byte_texts(batch.column("text"), CHUNK_BYTES):
                for i, text in zip(ids[a : a + len(whole)], whole, strict=True):
                    n, form, before, between, output = cut(pattern, text.decode(), i)
                    rows.append((n, form, before, between, sha(output), sha(restored(output, form))))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
