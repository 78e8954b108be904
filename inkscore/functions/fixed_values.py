"""Word lists, patterns and constants that decide results.

They are stated as plain text because results depend on them literally.
"""

from __future__ import annotations

# Character classes. SPACE is the set of characters Python's
# str.split() treats as whitespace; word characters are letters, marks, numbers.
SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"
WORD_CHARS = r"\p{L}\p{M}\p{N}"

WORD_PATTERN = rf"[{WORD_CHARS}]+"
TOKEN_PATTERN = rf"[{WORD_CHARS}]+|[^{SPACE}{WORD_CHARS}]"
SPACED_WORD_PATTERN = rf"[^{SPACE}]+"
SENTENCE_END_PATTERN = rf"[.!?]+([{SPACE}]|\z)"
TERM_PATTERN = rf"[{WORD_CHARS}_]{{2,}}"
QUOTE_PATTERN = r'"([^"]*)"'

# Punctuation marks whose share of the text is measured.
PUNCTUATION_MARKS = '.,!?;:"()[]{}'

# Cleaning steps, applied in this order as (pattern, replacement).
CLEANING_STEPS = (
    # links
    (rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+", ""),
    # comments, scripts, styles and tags
    (r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|</?[a-z!?][^>]*>", ""),
    # character references stand for marks, never for plain letters
    (r"&(?:[a-zA-Z]+[0-9]*|#[0-9]+|#[xX][0-9a-fA-F]+);", " "),
    # emoticons, pictographs, transport signs, flags, dingbats, enclosed characters
    (
        r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}"
        r"\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+",
        "",
    ),
    # everything that is neither a plain letter nor a digit, then repeated spaces
    (r"[^a-zA-Z\p{Nd}]+", " "),
)

# English stop words (public list distributed with NLTK).
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don don't should should've
now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn
shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# Readability formulas.
EASE_BASE, EASE_PER_SENTENCE, EASE_PER_WORD = 206.835, 1.015, 84.6
GRADE_PER_SENTENCE, GRADE_PER_WORD, GRADE_BASE = 0.39, 11.8, 15.59
FOG_FACTOR = 0.4
COMPLEX_WORD_SYLLABLES = 3

# Normalisation constant of the compound valence score.
COMPOUND_ALPHA = 15.0

# Weight given to passage words in the spelling dictionary.
PASSAGE_WORD_FREQUENCY = 1000

# Word valence in [-4, 4], polarity in [-1, 1], subjectivity in [0, 1].
BUILTIN_LEXICON = tuple(
    (word, float(polarity), float(subjectivity), float(valence))
    for word, polarity, subjectivity, valence in (
        line.split()
        for line in """
        amazing 0.6 0.9 2.8
        angry -0.5 1.0 -2.3
        awful -1.0 1.0 -2.0
        bad -0.7 0.667 -2.5
        beautiful 0.85 1.0 2.9
        best 1.0 0.3 3.2
        better 0.5 0.5 1.9
        boring -1.0 1.0 -1.3
        brave 0.8 1.0 2.4
        brilliant 0.9 1.0 2.8
        clear 0.1 0.383 1.6
        cruel -1.0 1.0 -2.8
        danger -0.6 0.8 -2.4
        dangerous -0.6 0.9 -2.1
        dead -0.2 0.4 -3.3
        difficult -0.5 1.0 -1.5
        easy 0.433 0.833 1.9
        excellent 1.0 1.0 2.7
        excited 0.375 0.75 1.4
        fail -0.5 0.3 -2.5
        fair 0.7 0.9 1.3
        false -0.4 0.6 -0.6
        fear -0.4 0.6 -2.2
        free 0.4 0.8 2.3
        friend 0.3 0.4 2.2
        fun 0.3 0.2 2.3
        good 0.7 0.6 1.9
        great 0.8 0.75 3.1
        happy 0.8 1.0 2.7
        hard -0.292 0.542 -0.4
        hate -0.8 0.9 -2.7
        helpful 0.4 0.4 1.8
        honest 0.6 0.9 2.3
        hope 0.4 0.5 1.9
        horrible -1.0 1.0 -2.5
        hurt -0.4 0.7 -2.4
        important 0.4 1.0 0.8
        interesting 0.5 0.5 1.7
        joy 0.8 0.2 2.8
        kill -0.6 0.7 -3.7
        kind 0.6 0.9 2.4
        lost -0.3 0.5 -1.3
        love 0.5 0.6 3.2
        nice 0.6 1.0 1.8
        pain -0.6 0.7 -2.3
        perfect 1.0 1.0 2.7
        poor -0.4 0.6 -2.1
        pretty 0.25 1.0 2.2
        proud 0.8 1.0 2.1
        sad -0.5 1.0 -2.1
        safe 0.5 0.5 1.9
        scared -0.5 0.9 -1.9
        sick -0.714 0.857 -2.3
        smart 0.214 0.643 1.7
        strong 0.433 0.733 2.3
        stupid -0.8 1.0 -2.4
        success 0.3 0.0 2.7
        terrible -1.0 1.0 -2.1
        trouble -0.2 0.2 -1.7
        true 0.35 0.65 1.8
        ugly -0.7 1.0 -2.3
        unhappy -0.6 0.9 -1.8
        useful 0.3 0.0 1.9
        war -0.5 0.5 -2.9
        weak -0.375 0.625 -1.9
        win 0.8 0.4 2.8
        wonderful 1.0 1.0 2.7
        worse -0.4 0.6 -2.1
        worst -1.0 1.0 -3.1
        wrong -0.5 0.9 -2.1
        """.strip().splitlines()
    )
)

# Part-of-speech rules. A rule is (kind, values, tag); the first rule
# that applies to a token decides. "word" compares the lower-cased token, "suffix"
# its ending; "capital" is a token whose first character lower-casing changes,
# "number" one of numerals only, "mark" a single character outside words.
TAG_RULES = (
    ("word", tuple("the a an this that these those every each no some any".split()), "DT"),
    ("word", tuple("i me you he him she her it we us they them myself himself herself itself".split()), "PRP"),
    ("word", tuple("my your his its our their".split()), "PRP$"),
    ("word", tuple("and or but nor yet".split()), "CC"),
    (
        "word",
        tuple(
            "of in on at by for with from about into over under between through during after before as than"
            " because if while until".split()
        ),
        "IN",
    ),
    ("word", ("to",), "TO"),
    ("word", tuple("can could may might must shall should will would".split()), "MD"),
    ("word", tuple("is are was were be been being am has have had do does did".split()), "VB"),
    ("word", tuple("who what which whom whose".split()), "WP"),
    ("word", tuple("when where why how".split()), "WRB"),
    ("word", tuple("not very also too never always often just only".split()), "RB"),
    ("suffix", ("ly",), "RB"),
    ("suffix", ("ing",), "VBG"),
    ("suffix", ("ed",), "VBD"),
    ("suffix", tuple("able ible al ful ic ive less ous".split()), "JJ"),
    ("suffix", ("est",), "JJS"),
    ("suffix", tuple("ment ness tion sion ity ance ence ship ism".split()), "NN"),
    ("capital", (), "NNP"),
    ("suffix", ("ss",), "NN"),
    ("suffix", ("s",), "NNS"),
    ("number", (), "CD"),
    ("mark", (), "PUNCT"),
)
DEFAULT_TAG = "NN"

# Column names of the feature tables, in their order. They are the tables' interface.
ID_COLUMNS = (
    "student_id",
    "prompt_id",
    "text",
    "fixed_summary_text",
    "prompt_question",
    "prompt_title",
    "prompt_text",
)
BASIC_FEATURES = (
    "summary_length",
    "splling_err_num",
    "prompt_length",
    "word_overlap_count",
    "bigram_overlap_count",
    "bigram_overlap_ratio",
    "trigram_overlap_count",
    "trigram_overlap_ratio",
    "quotes_count",
)
ENRICHED_FEATURES = (
    "summary_length",
    "splling_err_num",
    "prompt_length",
    "gunning_fog_prompt",
    "flesch_kincaid_grade_level_prompt",
    "flesch_reading_ease_prompt",
    "flesch_reading_ease",
    "word_count",
    "sentence_length",
    "vocabulary_richness",
    "word_count2",
    "num_unq_words",
    "num_chars",
    "avg_word_length",
    "comma_count",
    "semicolon_count",
    "length_ratio",
    "word_overlap_count",
    "bigram_overlap_count",
    "bigram_overlap_ratio",
    "trigram_overlap_count",
    "trigram_overlap_ratio",
    "quotes_count",
    "exclamation_count",
    "question_count",
    "pos_mean",
    "punctuation_sum",
    "keyword_density",
    "jaccard_similarity",
    "sentiment_polarity",
    "sentiment_subjectivity",
    "text_similarity",
    "gunning_fog",
    "flesch_kincaid_grade_level",
    "count_difficult_words",
    "neg",
    "neu",
    "pos",
    "compound",
    "neg_prompt",
    "neu_prompt",
    "pos_prompt",
    "compound_prompt",
)
