"""Line-first quality rules for documents.

Every ``\\n``-split line is judged on its own; failing lines are removed; a document that loses
too much of its text is rejected, and so is one that fails the base rules (too few words, or too
many words in repeated 3-word windows). A line with a word fails when

* punctuation: it does not end in a closing mark, or marks make up more than ``MARK_SHARE`` percent
  of its non-blank characters (and are ``MARK_LEAST`` at least);
* navigation: ``NAV_SHARE`` percent or more of its words are separators such as ``|`` or ``>``;
* boilerplate: it holds a stock phrase (licence, cookie, script notices);
* repeat: it equals an earlier line of the document.

Lines without a word neither fail nor count. Words are runs of ``[^\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from marketframe.llm import textbytes as tb

MIN_WORDS = 50
REPEAT_SHARE = 50      # percent of words in repeated 3-word windows
MARK_SHARE = 20        # percent of a line's non-blank characters
MARK_LEAST = 4
NAV_SHARE = 20         # percent of a line's words
LOSS_SHARE = 50        # percent of a document's word characters
#: Patterns shared with the SQL form (RE2 syntax in both engines).
CLOSED = r"""[.!?:;"')\]»”’…。！？；：）」』】》〉｡][\x20\x09-\x0D]*$"""
MARK = r"""[!-/:-@\[-`{-~]"""
SEPARATOR = r"[\x20\x09][|>»•/][\x20\x09]"
BOILERPLATE = (r"(?i)licensed under|all rights reserved|copyright \(c\)|©|cookie|javascript|"
               r"privacy policy|terms of (?:use|service)|lorem ipsum|subscribe to|click here|"
               r"sign up|log ?in to")
SYMBOLS = b"#*$%&|<>"
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
           "kept", "lost_chars")


def _twice(key: np.ndarray, later_only: bool = False) -> np.ndarray:
    """Marks the entries whose key occurs again (``later_only``: not the first of them)."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:]] = same
    if not later_only:
        out[order[:-1]] |= same
    return out


def _judge(texts, boilerplate: str = BOILERPLATE):
    """Columns of the documents (without doc_id) and the verdict of every line of one slice."""
    import pyarrow.compute as pc
    split = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    line_first = split.offsets.to_numpy().astype(np.int64)
    line_first = line_first - line_first[0]
    lines = split.flatten()
    data, off = tb.text_bytes(lines)
    starts, ends, first = tb.word_bounds(data, off)          # first: by line
    line_words = np.diff(first)
    doc_first = first[line_first]                            # first word of every document
    line_doc = np.repeat(np.arange(len(line_first) - 1), np.diff(line_first))
    total = lambda per_line: np.add.reduceat(np.append(per_line, 0), line_first[:-1]) if len(per_line) \
        else np.zeros(len(line_first) - 1, np.int64)  # noqa: E731  every document has a line
    within = lambda mask, at: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])

    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])   # code points before a byte
    word_points = points[ends] - points[starts]
    line_chars = np.diff(np.concatenate([[0], np.cumsum(word_points)])[first])
    n_symbols = within(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)), off)

    words = tb.word_hashes(data, starts, ends)
    at = tb.window_starts(doc_first, 3)
    twice = _twice(tb.mix(tb.window_hashes(words, at, 3) + tb.mix(tb.owner(doc_first, at).astype(np.uint64))))
    repeated = np.zeros(len(words), bool)
    for i in range(3):
        repeated[at[twice] + i] = True

    line_key = tb.run_hashes(data, off[:-1], off[1:], 2)
    has_word = line_words > 0
    again = _twice(tb.mix(line_key + tb.mix(line_doc.astype(np.uint64))), later_only=True) & has_word

    read = lambda a: a.to_numpy(zero_copy_only=False)
    marks = read(pc.count_substring_regex(lines, MARK)).astype(np.int64)
    closed = read(pc.match_substring_regex(lines, CLOSED))
    separators = read(pc.count_substring_regex(lines, SEPARATOR)).astype(np.int64)
    stock = read(pc.match_substring_regex(lines, boilerplate))
    noisy = (marks >= MARK_LEAST) & (marks * 100 > MARK_SHARE * line_chars)
    menu = (separators >= 2) & (separators * 100 >= NAV_SHARE * line_words)
    fails = has_word & (~closed | noisy | menu | stock | again)

    n_words, chars = np.diff(doc_first), total(line_chars)
    n_repeat = within(repeated, doc_first)
    lost = total(line_chars * fails)
    base_failed = (n_words < MIN_WORDS) | (100 * n_repeat > REPEAT_SHARE * n_words)
    kept = ~base_failed & (100 * lost <= LOSS_SHARE * chars)
    return (n_words, chars, total(n_symbols), total(again.astype(np.int64)), n_repeat, base_failed,
            kept, lost), lines, line_first, fails


def quality_rules(docs: DataFrame, with_text: bool = False, boilerplate: str = BOILERPLATE) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: the base figures, ``base_failed``, the verdict
    ``kept`` and ``lost_chars`` (code points of words on removed lines); ``with_text`` adds
    ``clean_text``, the remaining lines joined by ``\\n``; ``boilerplate`` is the pattern (RE2) of stock phrases. Null text counts as empty: no words, so
    it is rejected. Repeated rows stay repeated; other columns are ignored; no shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
              "n_repeat_words long, base_failed boolean, kept boolean, lost_chars long")

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for part in tb.slices(batch, limit=tb.SMALL_SLICE):
                columns, lines, line_first, fails = _judge(part.column("text"), boilerplate)
                out = dict(zip(COLUMNS, map(pa.array, columns)))
                if with_text:
                    good = lines.to_pylist()
                    out["clean_text"] = pa.array([
                        "\n".join(good[i] for i in range(a, b) if not fails[i])
                        for a, b in zip(line_first[:-1], line_first[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *out.values()], ["doc_id", *out])

    return tb.small_batches(docs).select("doc_id", "text").mapInArrow(run, schema + ", clean_text string" * with_text)
