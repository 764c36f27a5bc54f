"""Fixed vocabularies. All values here are fixed: results depend on them as they stand."""

from __future__ import annotations

# Canonical book names, in order. Fixed values.
BOOKS = [
    "genesis", "exodus", "leviticus", "numbers", "deuteronomy", "joshua", "judges", "ruth", "1 samuel", "2 samuel", "1 kings",
    "2 kings", "1 chronicles", "2 chronicles", "ezra", "nehemiah", "esther", "job", "psalms", "proverbs", "ecclesiastes",
    "song of solomon", "isaiah", "jeremiah", "lamentations", "ezekiel", "daniel", "hosea", "joel", "amos", "obadiah", "jonah",
    "micah", "nahum", "habakkuk", "zephaniah", "haggai", "zechariah", "malachi", "matthew", "mark", "luke", "john", "acts", "romans",
    "1 corinthians", "2 corinthians", "galatians", "ephesians", "philippians", "colossians", "1 thessalonians", "2 thessalonians",
    "1 timothy", "2 timothy", "titus", "philemon", "hebrews", "james", "1 peter", "2 peter", "1 john", "2 john", "3 john", "jude",
    "revelation",
]

# Abbreviation -> canonical name. Fixed values.
BOOK_ABBREVIATIONS = {
    "gen": "genesis", "ex": "exodus", "exod": "exodus", "lev": "leviticus", "num": "numbers", "deut": "deuteronomy",
    "dt": "deuteronomy", "josh": "joshua", "judg": "judges", "1 sam": "1 samuel", "1sam": "1 samuel", "2 sam": "2 samuel",
    "2sam": "2 samuel", "1 kgs": "1 kings", "1kgs": "1 kings", "1 ki": "1 kings", "2 kgs": "2 kings", "2kgs": "2 kings",
    "2 ki": "2 kings", "1 chr": "1 chronicles", "1chr": "1 chronicles", "2 chr": "2 chronicles", "2chr": "2 chronicles",
    "neh": "nehemiah", "est": "esther", "ps": "psalms", "psa": "psalms", "psalm": "psalms", "prov": "proverbs", "pr": "proverbs",
    "eccl": "ecclesiastes", "ecc": "ecclesiastes", "song": "song of solomon", "sos": "song of solomon", "isa": "isaiah",
    "jer": "jeremiah", "lam": "lamentations", "ezek": "ezekiel", "ezk": "ezekiel", "dan": "daniel", "hos": "hosea",
    "obad": "obadiah", "ob": "obadiah", "mic": "micah", "nah": "nahum", "hab": "habakkuk", "zeph": "zephaniah", "hag": "haggai",
    "zech": "zechariah", "mal": "malachi", "mt": "matthew", "matt": "matthew", "mk": "mark", "mrk": "mark", "lk": "luke",
    "jn": "john", "joh": "john", "rom": "romans", "1 cor": "1 corinthians", "1cor": "1 corinthians", "2 cor": "2 corinthians",
    "2cor": "2 corinthians", "gal": "galatians", "eph": "ephesians", "phil": "philippians", "col": "colossians",
    "1 thess": "1 thessalonians", "1thess": "1 thessalonians", "1 th": "1 thessalonians", "2 thess": "2 thessalonians",
    "2thess": "2 thessalonians", "2 th": "2 thessalonians", "1 tim": "1 timothy", "1tim": "1 timothy", "2 tim": "2 timothy",
    "2tim": "2 timothy", "tit": "titus", "phlm": "philemon", "heb": "hebrews", "jas": "james", "jms": "james", "1 pet": "1 peter",
    "1pet": "1 peter", "2 pet": "2 peter", "2pet": "2 peter", "1 jn": "1 john", "1jn": "1 john", "2 jn": "2 john", "2jn": "2 john",
    "3 jn": "3 john", "3jn": "3 john", "rev": "revelation",
}

# Topic -> synonyms; a query is expanded by the first two, in this order. Fixed values.
SYNONYMS = {
    "prayer": ["praying", "intercession", "communion with God", "talking to God"],
    "faith": ["believe", "believing", "trust", "confidence in God"],
    "salvation": ["saved", "redemption", "being born again", "conversion"],
    "forgiveness": ["forgiving", "mercy", "pardoning", "grace"],
    "love": ["loving", "charity", "compassion", "agape"],
    "worship": ["worshiping", "praise", "adoration", "glorifying God"],
    "sin": ["sinning", "transgression", "iniquity", "wrongdoing"],
    "repentance": ["repent", "turning from sin", "changing", "transformation"],
    "grace": ["unmerited favor", "God's kindness", "divine favor"],
    "sanctification": ["holiness", "being made holy", "spiritual growth", "transformation"],
    "obedience": ["obeying", "submitting", "following God's commands", "faithful living"],
    "righteousness": ["righteous", "right standing with God", "justified", "justification"],
    "discipleship": ["disciple", "following jesus", "commitment", "dedication"],
    "humility": ["humble", "humbleness", "lowliness", "meekness"],
    "word of god": ["scripture", "bible", "god's word", "the word"],
    "kingdom": ["kingdom of god", "kingdom of heaven", "god's kingdom", "eternal kingdom"],
    "suffering": ["trials", "tribulation", "hardship", "persecution", "endurance"],
    "hope": ["hopeful", "expectation", "assurance", "confidence in God"],
    "peace": ["peaceful", "shalom", "rest in God", "comfort"],
}

# Weekday -> number, Monday 0. Fixed values.
WEEKDAYS = {
    "monday": 0, "mon": 0, "tuesday": 1, "tue": 1, "wednesday": 2, "wed": 2, "thursday": 3, "thu": 3, "friday": 4, "fri": 4,
    "saturday": 5, "sat": 5, "sunday": 6, "sun": 6,
}
# Days on which services are held. Fixed values.
SERVICE_WEEKDAYS = (6, 2)

# Month name -> number. Fixed values.
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6,
    "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10, "november": 11,
    "nov": 11, "december": 12, "dec": 12,
}

# Chunk types that a question about a sermon or a lesson looks at. Fixed values.
SERMON_TYPES = ("sermon", "scripture")
LESSON_TYPES = ("30 lessons",)
