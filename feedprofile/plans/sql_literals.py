"""Patterns and lists of the SQL forms, written out and not taken from the functions, so that the two can disagree."""

# fixed values
TOKEN = r"[\p{L}\p{N}_]+"
WORD_OF_TWO = r"[\p{L}\p{N}_]{2,}"
HASHTAG = r"#[\p{L}\p{N}_]+"
LINK = r"http[^\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
EMOJI = (
    r"[\x{1F1E6}-\x{1F1FF}]{2}|[0-9#*]\x{FE0F}?\x{20E3}|"
    r"[\x{A9}-\x{A9}\x{AE}-\x{AE}\x{203C}-\x{203C}\x{2049}-\x{2049}\x{2122}-\x{2122}\x{2139}-\x{2139}\x{2194}-\x{21AA}\x{231A}-\x{23FF}"
    r"\x{24C2}-\x{24C2}\x{25AA}-\x{25FE}\x{2600}-\x{27BF}\x{2934}-\x{2935}\x{2B05}-\x{2B55}\x{3030}-\x{3030}\x{303D}-\x{303D}"
    r"\x{3297}-\x{3297}\x{3299}-\x{3299}\x{1F000}-\x{1F1E5}\x{1F200}-\x{1FAFF}](?:\x{FE0F}|[\x{1F3FB}-\x{1F3FF}])?[\x{E0020}-\x{E007F}]*"
    r"(?:\x{200D}[\x{A9}-\x{A9}\x{AE}-\x{AE}\x{203C}-\x{203C}\x{2049}-\x{2049}\x{2122}-\x{2122}\x{2139}-\x{2139}\x{2194}-\x{21AA}"
    r"\x{231A}-\x{23FF}\x{24C2}-\x{24C2}\x{25AA}-\x{25FE}\x{2600}-\x{27BF}\x{2934}-\x{2935}\x{2B05}-\x{2B55}\x{3030}-\x{3030}"
    r"\x{303D}-\x{303D}\x{3297}-\x{3297}\x{3299}-\x{3299}\x{1F000}-\x{1F1E5}\x{1F200}-\x{1FAFF}](?:\x{FE0F}|[\x{1F3FB}-\x{1F3FF}])?["
    r"\x{E0020}-\x{E007F}]*)*"
)
NORMALISER = (
    ("re", r"http(?:s)*://[\p{L}\p{N}_]+\.[\p{L}\p{N}_/]*(?:[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|$)", " <URL> "),
    ("plain", "\n", ""),
    ("plain", r"#", " <HASHTAG> "),
    ("re", r"(?:^|[^\p{L}\p{N}_])@[\p{L}\p{N}_]*[^\p{L}\p{N}_]", " <USER> "),
    ("re", r":\)|;\)|:-\)|;-\)|:\(|:-\(|:-o|:o|<3", " <EMOTICON> "),
    ("re", r"[\x{a9}\x{ae}\x{2000}-\x{3300}]", " <EMOJI> "),
    ("re", r"(?:^|\P{Nd})\p{Nd}+:\p{Nd}+", " <TIME> "),
    ("re", r"(?:^|\P{Nd})\p{Nd}+[.'\p{Nd}]*\P{Nd}", " <NUMBER> "),
    ("re", r"[^\x{00}-\x{7F}]+", ""),
    ("re", r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", " "),
)
# fixed values
PRONOUNS = (
    "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "their", "our", "mine", "yours",
)
# fixed values
DETERMINERS_AND_QUANTIFIERS = (
    "the", "a", "an", "this", "that", "these", "those", "my", "your", "his", "her", "its", "our", "their", "all", "some", "many", "few",
    "several", "much", "more", "most", "less", "least", "two", "three", "four", "five",
)
