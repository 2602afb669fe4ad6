"""Unicode block table for the block histogram."""

from __future__ import annotations

# ---------------------------------------------------------------- fixed values
# Block name, first and last code point, in code point order. Every block
# starts and ends on a multiple of 16, which lets the histogram join on
# ``code_point >> 4`` instead of a range condition.
BLOCKS = [
    ("BasicLatin", 0x0020, 0x007F),
    ("Latin1Supplement", 0x00A0, 0x00FF),
    ("LatinExtendedA", 0x0100, 0x017F),
    ("LatinExtendedB", 0x0180, 0x024F),
    ("IPAExtensions", 0x0250, 0x02AF),
    ("SpacingModifierLetters", 0x02B0, 0x02FF),
    ("CombiningDiacriticalMarks", 0x0300, 0x036F),
    ("GreekandCoptic", 0x0370, 0x03FF),
    ("Cyrillic", 0x0400, 0x04FF),
    ("CyrillicSupplementary", 0x0500, 0x052F),
    ("Armenian", 0x0530, 0x058F),
    ("Hebrew", 0x0590, 0x05FF),
    ("Arabic", 0x0600, 0x06FF),
    ("Syriac", 0x0700, 0x074F),
    ("Thaana", 0x0780, 0x07BF),
    ("Devanagari", 0x0900, 0x097F),
    ("Bengali", 0x0980, 0x09FF),
    ("Gurmukhi", 0x0A00, 0x0A7F),
    ("Gujarati", 0x0A80, 0x0AFF),
    ("Oriya", 0x0B00, 0x0B7F),
    ("Tamil", 0x0B80, 0x0BFF),
    ("Telugu", 0x0C00, 0x0C7F),
    ("Kannada", 0x0C80, 0x0CFF),
    ("Malayalam", 0x0D00, 0x0D7F),
    ("Sinhala", 0x0D80, 0x0DFF),
    ("Thai", 0x0E00, 0x0E7F),
    ("Lao", 0x0E80, 0x0EFF),
    ("Tibetan", 0x0F00, 0x0FFF),
    ("Myanmar", 0x1000, 0x109F),
    ("Georgian", 0x10A0, 0x10FF),
    ("HangulJamo", 0x1100, 0x11FF),
    ("Ethiopic", 0x1200, 0x137F),
    ("Cherokee", 0x13A0, 0x13FF),
    ("UnifiedCanadianAboriginalSyllabics", 0x1400, 0x167F),
    ("Ogham", 0x1680, 0x169F),
    ("Runic", 0x16A0, 0x16FF),
    ("Tagalog", 0x1700, 0x171F),
    ("Hanunoo", 0x1720, 0x173F),
    ("Buhid", 0x1740, 0x175F),
    ("Tagbanwa", 0x1760, 0x177F),
    ("Khmer", 0x1780, 0x17FF),
    ("Mongolian", 0x1800, 0x18AF),
    ("Limbu", 0x1900, 0x194F),
    ("TaiLe", 0x1950, 0x197F),
    ("KhmerSymbols", 0x19E0, 0x19FF),
    ("PhoneticExtensions", 0x1D00, 0x1D7F),
    ("LatinExtendedAdditional", 0x1E00, 0x1EFF),
    ("GreekExtended", 0x1F00, 0x1FFF),
    ("GeneralPunctuation", 0x2000, 0x206F),
    ("SuperscriptsandSubscripts", 0x2070, 0x209F),
    ("CurrencySymbols", 0x20A0, 0x20CF),
    ("CombiningDiacriticalMarksforSymbols", 0x20D0, 0x20FF),
    ("LetterlikeSymbols", 0x2100, 0x214F),
    ("NumberForms", 0x2150, 0x218F),
    ("Arrows", 0x2190, 0x21FF),
    ("MathematicalOperators", 0x2200, 0x22FF),
    ("MiscellaneousTechnical", 0x2300, 0x23FF),
    ("ControlPictures", 0x2400, 0x243F),
    ("OpticalCharacterRecognition", 0x2440, 0x245F),
    ("EnclosedAlphanumerics", 0x2460, 0x24FF),
    ("BoxDrawing", 0x2500, 0x257F),
    ("BlockElements", 0x2580, 0x259F),
    ("GeometricShapes", 0x25A0, 0x25FF),
    ("MiscellaneousSymbols", 0x2600, 0x26FF),
    ("Dingbats", 0x2700, 0x27BF),
    ("MiscellaneousMathematicalSymbolsA", 0x27C0, 0x27EF),
    ("SupplementalArrowsA", 0x27F0, 0x27FF),
    ("BraillePatterns", 0x2800, 0x28FF),
    ("SupplementalArrowsB", 0x2900, 0x297F),
    ("MiscellaneousMathematicalSymbolsB", 0x2980, 0x29FF),
    ("SupplementalMathematicalOperators", 0x2A00, 0x2AFF),
    ("MiscellaneousSymbolsandArrows", 0x2B00, 0x2BFF),
    ("CJKRadicalsSupplement", 0x2E80, 0x2EFF),
    ("KangxiRadicals", 0x2F00, 0x2FDF),
    ("IdeographicDescriptionCharacters", 0x2FF0, 0x2FFF),
    ("CJKSymbolsandPunctuation", 0x3000, 0x303F),
    ("Hiragana", 0x3040, 0x309F),
    ("Katakana", 0x30A0, 0x30FF),
    ("Bopomofo", 0x3100, 0x312F),
    ("HangulCompatibilityJamo", 0x3130, 0x318F),
    ("Kanbun", 0x3190, 0x319F),
    ("BopomofoExtended", 0x31A0, 0x31BF),
    ("KatakanaPhoneticExtensions", 0x31F0, 0x31FF),
    ("EnclosedCJKLettersandMonths", 0x3200, 0x32FF),
    ("CJKCompatibility", 0x3300, 0x33FF),
    ("CJKUnifiedIdeographsExtensionA", 0x3400, 0x4DBF),
    ("YijingHexagramSymbols", 0x4DC0, 0x4DFF),
    ("CJKUnifiedIdeographs", 0x4E00, 0x9FFF),
    ("YiSyllables", 0xA000, 0xA48F),
    ("YiRadicals", 0xA490, 0xA4CF),
    ("HangulSyllables", 0xAC00, 0xD7AF),
    ("HighSurrogates", 0xD800, 0xDB7F),
    ("HighPrivateUseSurrogates", 0xDB80, 0xDBFF),
    ("LowSurrogates", 0xDC00, 0xDFFF),
    ("PrivateUseArea", 0xE000, 0xF8FF),
    ("CJKCompatibilityIdeographs", 0xF900, 0xFAFF),
    ("AlphabeticPresentationForms", 0xFB00, 0xFB4F),
    ("ArabicPresentationFormsA", 0xFB50, 0xFDFF),
    ("VariationSelectors", 0xFE00, 0xFE0F),
    ("CombiningHalfMarks", 0xFE20, 0xFE2F),
    ("CJKCompatibilityForms", 0xFE30, 0xFE4F),
    ("SmallFormVariants", 0xFE50, 0xFE6F),
    ("ArabicPresentationFormsB", 0xFE70, 0xFEFF),
    ("HalfwidthandFullwidthForms", 0xFF00, 0xFFEF),
    ("Specials", 0xFFF0, 0xFFFF),
]


def bucket_rows():
    """(bucket, block) rows, bucket = code_point >> 4, derived from BLOCKS.

    At most 4,096 rows (the Basic Multilingual Plane), so the table is safe
    to broadcast."""
    return [(b, name) for name, lo, hi in BLOCKS for b in range(lo >> 4, (hi >> 4) + 1)]


def values_sql() -> str:
    """The block table as a SQL VALUES list (for the oracle)."""
    return ", ".join(f"('{n}', {lo}, {hi})" for n, lo, hi in BLOCKS)
