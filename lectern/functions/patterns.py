"""What transcripts and lesson notes are recognised by."""

# Fixed values. These patterns and word lists decide what counts as a date, a title, a heading, a
# credit or noise, so results agree only if they are exactly these. Java and Python read them alike.

# transcripts
BOUNDARY = r"(?i)본\s*문|SCRIPTURES|MAIN\s*TEXT|BIBLE"
FOOTER_TAGS = ("TR:", "TRX:", "ENPE:", "KOR:", "EDIT:", "TRANSLATED BY:")
DATE_IN_TEXT = r"(?i)(\d{1,2}[./]\d{1,2}[./]\d{4}|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4})"
SECTION_LABEL = r"(?i)^(scriptures|main\s*scriptures|hallelujah)[:\s!]*$"
SERVICE_HEADER = r"(?i)(sunday|monday|tuesday|wednesday|thursday|friday|saturday)[\w\s]*(message|service|worship|prayer)"
VERSION_TAG = r"(?i)^rev(ision)?\.?\s*[\d]*(?:\.[\d]+)*$"
TITLE_PHRASE = r"[A-Za-z][A-Za-z\s'\-\[\]]*[A-Za-z]"
FIRST_PARAGRAPHS = 20

# lesson notes
LESSON_NAME = r"(?i)^(\d{4})(\d{2})(\d{2})_([0-9\-]+)[\s_]+(.*?)(?:_+P[\s_]+\w+)?\.docx?$"
PAGE_FOOTER = r"^\d+\s*\|\s*\d+\s+\w"
REVIEWER = r"(?i)^(review(ed)?|edit(ed)?|compiled?(\s+and\s+\w+)?|compilation(\s+and\s+\w+)?|translat(ed|ion)?(\s+and\s+\w+)?|based)\s+(by|on)\b"
REVIEWER_WORDS = 10
COMMENTARY_INSTRUCTION = r"(?i)^show\s+commentar(y|ies)\s+here"
COMMENTATOR = r"^(dr\.?\s+)?[A-Z][a-z]+(\s+[A-Z]\.?)?\s+[A-Z][a-z]+(,\s*.+)?$"
COMMENTATOR_WORDS = 6
LESSON_FOOTER = r"(?i)^\d+[-\d]*\s+\w[\w\s]+\s+by\s+\w+\s+\d{6}$"
ATTRIBUTION = r"(?i)^(compiled|compilation|translated|translation|based\s+on)\b"
ATTRIBUTION_PARAGRAPHS = 10
LINK_LINE = r"^https?://\S+$"
LINKED_NAME = r"^\[.+\]\(.+\)$"
REFERENCE_HEADER = r"^(\d\s)?[A-Za-z]+[\w\s]*\d+:\d+[\d\-,\s]*$"
BRACKETED_REFERENCE = r"^\((\d?\s?[A-Za-z]+[\w\s]*\d+:\d+[\d\-,\s]*)\)\s*(.*)$"
SECTION_HEADER = r"^(\d+[.\-\d]*\.?|[A-Z]\.|[A-Z]\))\s+\S"
SECTION_NAMES = ("Introduction", "Main Body", "Conclusion")
SUBSECTION = r"^\d+\)\s+\S"
AHEAD, LEAST_WORDS = 3, 3

# cleaned texts
REFERENCE_TAG = r"(?s)^\[([^\]]+\d+:\d+[^\]]*)\](.*)"
VIDEO_START = r"(?i)^<vide?o?\s*\d+\s*start>"
VIDEO_END = r"(?i)^<vide?o?\s*\d+\s*end>"
