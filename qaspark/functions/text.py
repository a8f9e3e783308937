"""Text functions for answer scoring and cleaning, all as built-in Column
expressions (JVM side, whole-stage codegen); no Python UDF.

Word rules:
* a *word* is a maximal run of letters, numbers or underscore over the
  lower-cased text (the Unicode meaning of a regex word character);
* token recall compares *sets* of words, substring recall uses the *bag* of
  truth words and plain substring containment in the lower-cased prediction;
* a list of truths scores its best truth; no eligible truth scores 0.0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the scoring rules being reproduced) ----------
# Word character class: letters, numbers, underscore.
WORD_CLASS = r"[\p{L}\p{N}_]"
WORD_RE = WORD_CLASS + "+"
# Whitespace class of Python's str methods (strip/split) and of `\s` on text:
# ASCII \t \n \v \f \r and space, U+001C..U+001F, U+0085, U+00A0, U+1680,
# U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
WS_CLASS = (r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# The same whitespace set as explicit characters (for trim, which needs no regex).
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
            "\u2028\u2029\u202f\u205f\u3000")
# Sentinel answers: an empty generation and a failed generation.
NO_ANSWER = "No answer generated"
GEN_ERROR = "Error generating answer"
# Reasoning-tag patterns, in order: paired with content, self-closed, stray.
THINK_PATTERNS = (
    r"(?isu)<think>.*?</think>",
    r"(?iu)<think" + WS_CLASS + r"*/>",
    r"(?iu)</?think>",
)
# Boilerplate openers removed up to the next word character, in this order.
OPENER_PATTERNS = (
    r"(?isu)Step-by-Step Explanation:.*?(?=" + WORD_CLASS + ")",
    r"(?isu)Let me think.*?(?=" + WORD_CLASS + ")",
    r"(?isu)First,.*?(?=" + WORD_CLASS + ")",
)
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text) -> Column:
    """bag of words, ``array<string>`` (null text → null)."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD_RE), 0)


def tokens(text) -> Column:
    """set of words."""
    return F.array_distinct(words(text))


def join_texts(arr) -> Column:
    """a list given as one text is joined by single spaces."""
    return F.array_join(F.transform(_c(arr), lambda x: x.cast("string")), " ")


def strip_ws(text) -> Column:
    """Strip leading/trailing whitespace of the full Unicode class: ``btrim``
    with the explicit character set (plain ``trim`` only removes spaces); no
    regex, so only the two ends of the text are looked at."""
    return F.btrim(_c(text), F.lit(WS_CHARS))


def collapse_ws(text) -> Column:
    """every whitespace run becomes one space, then strip.

    Every whitespace character is first mapped to a space with ``translate``
    (no regex), so the remaining regex only squeezes runs of plain spaces."""
    spaced = F.translate(_c(text), WS_CHARS, " " * len(WS_CHARS))
    return F.trim(F.regexp_replace(spaced, F.lit("  +"), F.lit(" ")))


def _safe_ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def token_recall_one(pred_tokens, truth) -> Column:
    """|T ∩ P| / |T| for one truth text; 0.0 when the truth has no words."""
    return F.element_at(F.transform(
        F.array(tokens(truth)),
        lambda t: _safe_ratio(F.size(F.array_intersect(t, _c(pred_tokens))), F.size(t))), 1)


def token_recall(pred_tokens, truths) -> Column:
    """best token recall over a list of truths.

    ``pred_tokens`` must already be ``tokens(prediction)`` (computed once per row:
    lambdas do not share sub-expressions). Truths without words are skipped; no
    eligible truth → 0.0.
    """
    pt = _c(pred_tokens)
    per_truth = F.transform(_c(truths), lambda t: F.struct(tokens(t).alias("t")))
    eligible = F.filter(per_truth, lambda s: F.size(s["t"]) > 0)
    scores = F.transform(
        eligible,
        lambda s: F.size(F.array_intersect(s["t"], pt)).cast("double") / F.size(s["t"]).cast("double"))
    return F.coalesce(F.array_max(scores), F.lit(0.0))


def _substring_share(pred_lower: Column, w: Column) -> Column:
    hits = F.size(F.filter(w, lambda x: F.instr(pred_lower, x) > 0))
    return _safe_ratio(hits, F.size(w))


def substring_recall_one(pred_lower, truth) -> Column:
    """share of truth words (bag) found as substrings of the lower-cased
    prediction; 0.0 when the truth has no words."""
    # the word list is built once inside a one-element transform: lambdas do
    # not share sub-expressions, and the regex is the expensive part
    return F.element_at(F.transform(F.array(words(truth)),
                                    lambda w: _substring_share(_c(pred_lower), w)), 1)


def substring_recall(pred_lower, truths) -> Column:
    """best substring recall over non-empty truths; none → 0.0.

    ``pred_lower`` must be ``lower(prediction)`` computed once per row.
    """
    p = _c(pred_lower)
    eligible = F.filter(_c(truths), lambda t: t.isNotNull() & (t != ""))
    per_truth = F.transform(eligible, lambda t: F.struct(words(t).alias("w")))
    scores = F.transform(per_truth, lambda s: _substring_share(p, s["w"]))
    return F.coalesce(F.array_max(scores), F.lit(0.0))


def with_recalls(df, prediction: str, truths: str, substring_col: str = "substring_recall",
                 token_col: str = "token_recall"):
    """Add both recalls to ``df`` (F4 + F6), computing the prediction's token set
    and lower-cased text once per row."""
    tmp_t, tmp_l = "__pred_tokens", "__pred_lower"
    pred = F.coalesce(F.col(prediction), F.lit(""))
    return (df.withColumn(tmp_t, tokens(pred))
              .withColumn(tmp_l, F.lower(pred))
              .withColumn(substring_col, substring_recall(tmp_l, truths))
              .withColumn(token_col, token_recall(tmp_t, truths))
              .drop(tmp_t, tmp_l))


def strip_reasoning(text) -> Column:
    """drop reasoning tags (paired with content, self-closed, stray)."""
    c = _c(text)
    for p in THINK_PATTERNS:
        c = F.regexp_replace(c, F.lit(p), F.lit(""))
    return c


def strip_openers(text) -> Column:
    """drop boilerplate openers up to the next word character."""
    c = _c(text)
    for p in OPENER_PATTERNS:
        c = F.regexp_replace(c, F.lit(p), F.lit(""))
    return c


def clean_answer(text) -> Column:
    """The full answer clean-up applied to a generated text.

    strip → collapse whitespace → reasoning tags → openers → collapse again →
    empty becomes the no-answer sentinel. A null text is treated as empty.
    """
    c = collapse_ws(F.coalesce(_c(text), F.lit("")))
    c = strip_openers(strip_reasoning(c))
    c = collapse_ws(c)
    return F.when(c == "", F.lit(NO_ANSWER)).otherwise(c)


def is_sentinel(text) -> Column:
    """The answer is one of the two sentinel strings (still scored)."""
    return _c(text).isin(NO_ANSWER, GEN_ERROR)


SERIES_REPLACED = "/ "         # characters that become '_' in series and title names


def sanitize_series(name) -> Column:
    """'/' and ' ' become '_' in series and title names."""
    return F.translate(_c(name), SERIES_REPLACED, "_" * len(SERIES_REPLACED))
