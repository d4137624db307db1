"""Word lists of the language statistics."""

# fixed values
PRONOUNS = (
    "i", "you", "he", "she", "it", "we", "they",
    "me", "him", "her", "us", "them",
    "my", "your", "his", "their", "our", "mine", "yours",
)
# fixed values
DETERMINERS = (
    "the", "a", "an", "this", "that", "these", "those",
    "my", "your", "his", "her", "its", "our", "their",
)
# fixed values
QUANTIFIERS = (
    "all", "some", "many", "few", "several",
    "much", "more", "most", "less", "least",
    "two", "three", "four", "five",
)
#: A word in both lists counts once.
DETERMINERS_AND_QUANTIFIERS = tuple(dict.fromkeys(DETERMINERS + QUANTIFIERS))
