"""Text scalar functions (T1-T12): ``Column -> Column``, native expressions only.

Every function here compiles to Catalyst expressions (regexp_replace,
translate, btrim, split, filter, ...) so whole-stage codegen keeps the text
work inside the JVM; nothing round-trips through Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from parallax import constants as K

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# T1
def remove_vocalization(c: ColumnOrName) -> Column:
    """Delete Arabic diacritics: ``translate`` with no replacement deletes."""
    return F.translate(_col(c), K.DIACRITIC_CHARS, "")


# T2
def replace_arabic_punctuation(c: ColumnOrName) -> Column:
    return F.translate(_col(c), K.ARABIC_PUNCT_CHARS, " " * len(K.ARABIC_PUNCT_CHARS))


def _t1_t2(c: ColumnOrName) -> Column:
    """T1 then T2 in one character-map pass (the two sets are disjoint)."""
    return F.translate(_col(c), K.ARABIC_PUNCT_CHARS + K.DIACRITIC_CHARS,
                       " " * len(K.ARABIC_PUNCT_CHARS))


# All leading/trailing double quotes first, then single quotes.
def strip_outer_quotes(c: ColumnOrName) -> Column:
    return F.btrim(F.btrim(_col(c), F.lit('"')), F.lit("'"))


def strip_whitespace(c: ColumnOrName) -> Column:
    """Unicode-aware strip (Python ``str.strip()``), no inner collapse.

    ``btrim`` with the explicit character set: no regex scan of the text."""
    return F.btrim(_col(c), F.lit(K.WS_LITERAL))


# T4
def remove_extra_whitespace(c: ColumnOrName) -> Column:
    return F.regexp_replace(strip_whitespace(c), f"{K.JWS_CLASS}+", " ")


# T5
def normalize_arabic(c: ColumnOrName) -> Column:
    return F.translate(_col(c), K.NORMALIZE_FROM, K.NORMALIZE_TO)


# T6
def clean_text(c: ColumnOrName, normalize: bool = False) -> Column:
    out = remove_extra_whitespace(strip_outer_quotes(_t1_t2(c)))
    return normalize_arabic(out) if normalize else out


def whitespace_tokens(c: ColumnOrName) -> Column:
    """Python ``str.split()``: split on Unicode whitespace runs, no empty tokens."""
    return F.array_remove(F.split(_col(c), f"{K.JWS_CLASS}+"), "")


# T7
def english_token_ratio(c: ColumnOrName) -> Column:
    """English tokens / whitespace tokens, counted with two regex scans of the
    text (codegen'd ``regexp_count``) instead of building a token array."""
    n_tok = F.regexp_count(_col(c), F.lit(K.TOKEN_RUN))
    n_en = F.regexp_count(_col(c), F.lit(K.ENGLISH_TOKEN_RUN))
    # try_divide (null when there are no tokens) references each count once.
    return F.try_divide(n_en.cast("double"), n_tok)


# Ratio >= threshold; no tokens -> false.
def is_mostly_english(c: ColumnOrName, threshold: float = K.MOSTLY_ENGLISH_THRESHOLD) -> Column:
    return F.coalesce(english_token_ratio(c) >= F.lit(threshold), F.lit(False))


# T9
def is_english_only(c: ColumnOrName) -> Column:
    return F.coalesce(_col(c).rlike(K.ENGLISH_ONLY_JAVA), F.lit(False))


# T10
_SLOT = re.compile(r"\{(\w+)\}")


def render_template(template: str, **slots: ColumnOrName) -> Column:
    """Fill ``{name}`` slots with columns via ``concat`` (text is never a format string)."""
    parts: list[Column] = []
    pos = 0
    for m in _SLOT.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(_col(slots[m.group(1)]))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def generation_prompt(src: ColumnOrName, quoted: bool = False) -> Column:
    return render_template(K.GEN_PROMPT_QUOTED if quoted else K.GEN_PROMPT, slang=src)


def detection_prompt(src: ColumnOrName, tgt: ColumnOrName) -> Column:
    return render_template(K.DET_PROMPT, slang=src, formal=tgt)


# Drop the echoed prompt, keep the first line, strip.
def postprocess_completion(output: ColumnOrName, prompt: ColumnOrName) -> Column:
    rest = F.call_function("substring", _col(output), F.length(_col(prompt)) + 1)
    return strip_whitespace(F.substring_index(rest, "\n", 1))


# T12
def label_name(c: ColumnOrName) -> Column:
    return F.when(_col(c) == 1, F.lit(K.LABEL_CORRECT)).when(
        _col(c).isNotNull(), F.lit(K.LABEL_INCORRECT))


def label_value(c: ColumnOrName) -> Column:
    return F.when(_col(c) == K.LABEL_CORRECT, F.lit(1)).when(
        _col(c) == K.LABEL_INCORRECT, F.lit(0))


def transliterate_to_arabic(c: ColumnOrName) -> Column:
    """AR test fixture: map lower-cased Latin text onto Arabic code points."""
    return F.translate(F.lower(_col(c)), K.AR_FROM, K.AR_TO)
