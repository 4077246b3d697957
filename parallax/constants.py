"""Fixed values that must equal the behaviour being reproduced.

Everything in this module is data, not logic: character classes, prompt
templates, label names, model-input limits and decoding settings. They are
kept together so both the Spark code and the DuckDB oracle read one source.
"""

# --------------------------------------------------------------------------
# FIXED VALUES: text-cleaning character classes (Java regex / RE2 syntax).
# --------------------------------------------------------------------------

def _class_body(ranges: list[tuple[int, int]]) -> str:
    """Code-point ranges as the inside of a regex character class."""
    return "".join(rf"\x{{{lo:04X}}}" if lo == hi else rf"\x{{{lo:04X}}}-\x{{{hi:04X}}}" for lo, hi in ranges)


def _characters(ranges: list[tuple[int, int]]) -> str:
    """The same ranges as literal characters."""
    return "".join(chr(c) for lo, hi in ranges for c in range(lo, hi + 1))


# Arabic diacritics removed by T1 (vocalisation marks, Quranic annotations).
DIACRITIC_RANGES = [(0x0610, 0x061A), (0x064B, 0x065F), (0x0670, 0x0670), (0x06D6, 0x06DC),
                    (0x06DF, 0x06E4), (0x06E7, 0x06E8), (0x06EA, 0x06ED)]
# Arabic punctuation replaced by one space each (T2): comma, semicolon,
# question mark, percent sign, decimal separator, thousands separator.
ARABIC_PUNCT_RANGES = [(0x060C, 0x060C), (0x061B, 0x061B), (0x061F, 0x061F), (0x066A, 0x066C)]
# The whitespace set of Python's str.split()/strip()/\s, spelled out because
# Spark's \s is ASCII-only and (?U)\s misses U+001C..U+001F.
WS_RANGES = [(0x0009, 0x000D), (0x001C, 0x0020), (0x0085, 0x0085), (0x00A0, 0x00A0), (0x1680, 0x1680),
             (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]

# Derived: the sets as regex classes (Java and RE2), and as characters for
# translate() and btrim(), which need no regex.
DIACRITICS_CLASS = "[" + _class_body(DIACRITIC_RANGES) + "]"
DIACRITIC_CHARS = _characters(DIACRITIC_RANGES)
ARABIC_PUNCT_CLASS = "[" + _class_body(ARABIC_PUNCT_RANGES) + "]"
ARABIC_PUNCT_CHARS = _characters(ARABIC_PUNCT_RANGES)
WS_CHARS = _class_body(WS_RANGES)
WS_CLASS = "[" + WS_CHARS + "]"
WS_LITERAL = _characters(WS_RANGES)
# The same set for Spark's (Java) regex engine: Java's whitespace property
# plus the four no-break/next-line spaces Python also counts. Equal to the
# explicit class on every code point (tested), and 2-3x faster to match.
JWS_CHARS = r"\p{javaWhitespace}\x{0085}\x{00A0}\x{2007}\x{202F}"
JWS_CLASS = "[" + JWS_CHARS + "]"

# Light normalisation (T5): alef variants, teh marbuta, alef maksura,
# hamza on waw, hamza on ya.
NORMALIZE_FROM = "إأآةىؤئ"
NORMALIZE_TO = "اااهيوي"

# Token that counts as English for the language flag.
ENGLISH_TOKEN = r"^[A-Za-z]+$"
# The same two notions as patterns counted over the whole text: a token is a
# maximal run of non-whitespace; an English token is such a run of letters only.
TOKEN_RUN = "[^" + JWS_CHARS + "]+"
ENGLISH_TOKEN_RUN = "(?<![^" + JWS_CHARS + "])[A-Za-z]+(?![^" + JWS_CHARS + "])"

# Whole-string "English only" predicate (T9): ASCII letters, digits,
# whitespace and this punctuation list.
_ENGLISH_ONLY_PUNCT = r"\.,!?'" + '"' + r"@#\$%\^&\*\(\)\-_=\+"
ENGLISH_ONLY = "^[A-Za-z0-9" + WS_CHARS + _ENGLISH_ONLY_PUNCT + "]+$"
ENGLISH_ONLY_JAVA = "^[A-Za-z0-9" + JWS_CHARS + _ENGLISH_ONLY_PUNCT + "]+$"

MOSTLY_ENGLISH_THRESHOLD = 0.7

# --------------------------------------------------------------------------
# FIXED VALUES: prompt templates (T10). {name} marks a column slot.
# --------------------------------------------------------------------------
GEN_PROMPT = "عامية: {slang}\nفصحى: "
GEN_PROMPT_QUOTED = 'عامية: "{slang}"\nفصحى: '
DET_PROMPT = 'عامية: "{slang}"\nفصحى: "{formal}"\nهل الترجمة صحيحة؟ أجب بـ "نعم" أو "لا": '

# Request-validation error message.
EMPTY_INPUT_ERROR = "يرجى إدخال النص العامي"

# --------------------------------------------------------------------------
# FIXED VALUES: labels and model-input limits.
# --------------------------------------------------------------------------
LABEL_CORRECT = "correct"
LABEL_INCORRECT = "incorrect"
IGNORE_INDEX = -100

GEN_MAX_INPUT_LEN = 64
GEN_MAX_TARGET_LEN = 128
DET_MAX_SEQ_LEN = 160
GEN_BATCH_SIZE = 8
DET_BATCH_SIZE = 16

# Decoding settings used by candidate re-ranking.
TEMPERATURE = 0.7
TOP_K = 50
TOP_P = 0.92
REPETITION_PENALTY = 1.3

# Early stopping patience used by both trainers.
PATIENCE = 3

SEED = 42
SPLIT_RATIOS = (0.80, 0.10, 0.10)

# --------------------------------------------------------------------------
# FIXED VALUES: test transliteration map (AR fixture). Applied to lower(text)
# position by position so that Latin test documents exercise Arabic rules.
# --------------------------------------------------------------------------
AR_FROM = "abcdefghijklmnopqrstuvwxyzéèêçäöüß.,"
AR_TO = (
    "اأإآبتةثجحخدذىرؤزئسشصضطظعغ"
    "\u064e\u064f\u0650\u0651\u0652\u0670"  # six diacritics
    "فق؟،"
)
assert len(AR_FROM) == len(AR_TO) == 36
