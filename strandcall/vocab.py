"""Words and characters that results are compared on."""

# Answer classes, in the order in which an answer text is searched.
UP = "upregulated"
DOWN = "downregulated"
UNCHANGED = "not differentially expressed"
CLASSES = (UP, DOWN, UNCHANGED)

# Label codes of the two vocabularies.
TERNARY_TEXT = {0: UNCHANGED, 1: DOWN, 2: UP}
BINARY_TEXT = {0: "down", 1: "up"}

# What the critic may answer.
RATINGS = ("excellent", "good", "average", "bad", "terrible")

# Names used in reports.
NONE_EXTRACTED = "none_extracted"
NONE_OTHER = "None/Other"
NO_REASONING = "N/A"

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Columns that identify a sample.
SAMPLE_KEYS = ("pert", "gene", "cell_type")
