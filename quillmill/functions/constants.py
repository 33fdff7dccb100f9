"""Word lists, patterns and formats that results depend on."""

# --- Fixed values, to be kept as they are -----------------------------------------

FUNCTION_WORDS = (
    "a about above after against all already also although am among an and another any are around as at be "
    "because been before behind being below beside between beyond both but by can could dare did do does doing done "
    "during each either else even ever every few for from had has have he her here hers herself him himself his how "
    "i if in into is it its itself just least less many may me might mine more most much must my myself near need "
    "neither never no nor not now of off on only onto or other ought our ours ourselves out over own per same self "
    "several shall she should since so some still such than that the their theirs them themselves then there these "
    "they this those though through thus to too toward towards under unless until upon us used very was we were what "
    "when where whereas whether which while who whom whose why will with within without would yet you your yours "
    "yourself yourselves"
).split()

IRREGULAR_PARTICIPLES = (
    "bitten blown born broken brought cast caught chosen cut done drawn driven eaten fallen fed fled forgotten fought "
    "found given gone grown heard held hidden hit hurt kept known lain led left let lost made meant met paid put read "
    "ridden risen said seen sent set shed shown shut slept sold sought spent spoken stolen stood sworn taken taught "
    "thought thrown told torn understood woken worn written"
).split()

#: Their period ends no sentence; in any case of letters.
ABBREVIATIONS = (
    "Adm al Atty Bros Capt cf ch chap Cmdr Co Col Dr Esq etc fig Gen Gov Hon Inc Jr Lt Ltd Maj Miss Mlle Mme Mr Mrs Ms "
    "Mt No p pp Pres Prof Rep Rev sec Sen Sgt Sr St Supt viz vol vs"
).split()

NOMINAL_SUFFIXES = "age ance ence ery ism ity ment ness sion tion".split()

BE_FORMS = "am are is was were be been being".split()
BE_CONTRACTIONS = "'s 're 'm".split()

WORD = r"[A-Za-z][A-Za-z'\-]*"
FEATURE_WORD = r"\b[a-zA-Z][a-zA-Z'-]+\b"
SENTENCE_END = ".!?"
SENTENCE_START = "A-Z\"'“"

#: Paragraphs of the style profile need two blank lines, those of the chunker one.
PROFILE_PARAGRAPH = r"\n\s*\n\s*\n+"
CHUNK_PARAGRAPH = r"\n\s*\n+"

START_MARKER = r"\*\*\*\s*START OF (?:THE|THIS) PROJECT GUTENBERG EBOOK[^\n]*\n"
END_MARKER = r"\*\*\*\s*END OF (?:THE|THIS) PROJECT GUTENBERG EBOOK[^\n]*"
MARKER_NAME = "Project Gutenberg"
CHAPTER_HEADING = r"^[ \t]*(?:CHAPTER|Chapter)\s+(?:[IVXLCDM]+|\d+|[A-Za-z]+)\.?\s*$"

BRIEF_LABEL = r"^(?:Brief|Sentence|Description|Summary|Scene|Answer)\s*[:\-—]\s*"
NOT_PROSE_TITLE = (
    r"\b(index of|poems?|poetry|verse|ballads?|rhymes?|sonnets?|musical comed|play in (?:one|two|three|four|five) acts?|"
    r"chamber music|black riders|symptoms of being)\b"
)
LEAKED_BRIEF = (
    r"(?:\bclassic novels\b|\bThese classic\b|\bedited by\b|\b(?:1[89]\d{2}) edition\b|"
    r"(?:\"[A-Z][A-Za-z ]+\",?\s+(?:by|including)\s+){2,})"
)

PROMPT = ("[INST] Continue this scene in ", " style: ", " [/INST] ")
INSTRUCTION_END = "[/INST]"
BASELINE_GENERIC = "You are an expert prose writer. Continue the requested scene in literary English, no preamble or meta-commentary, no headings."
BASELINE_SUFFIX = " No preamble or meta-commentary."
BASELINE_START = "Begin the scene now."
BRIEF_INSTRUCTION = "In one short sentence, describe what happens in the scene below. Use plain modern English; do not imitate the prose style. No preamble, no quotation, no preface — just the sentence."

#: (id, sentence) in the order in which briefs are dealt to them.
CONSTRAINTS = (
    ("first_person", "Use first-person past-tense narration."),
    ("named_eleanor", "Include a character named Eleanor."),
    ("weather", "Include exactly one weather observation."),
    ("no_dialogue", "Use no spoken dialogue at all."),
    ("ends_question", "End the scene with a question mark."),
    ("under_200_words", "Limit the scene to under 200 words."),
    ("set_at_dawn", "Set the scene at dawn."),
    ("object_held", "Mention an object the protagonist is holding or carrying."),
)

#: (name, display, authors, style hint)
REGISTERS = (
    ("victorian-formal", "Victorian formal realism", ("Jane Austen", "Anthony Trollope", "George Eliot", "Elizabeth Gaskell"), "Write in the style of nineteenth-century English realism: measured periodic sentences, formal diction, free indirect style for character interiority, careful social observation."),
    ("romantic-ornate", "Romantic ornate", ("Charlotte Brontë", "Emily Brontë", "Anne Brontë", "Nathaniel Hawthorne", "Walter Scott"), "Write in the Romantic mode: long sinuous sentences, elevated diction, extended descriptive passages of landscape and weather, intense first- or third-person interiority."),
    ("gothic-dark", "Gothic dark", ("Edgar Allan Poe", "Bram Stoker", "Joseph Sheridan Le Fanu", "M. R. James"), "Write in the Gothic mode: atmospheric and foreboding, archaic diction, ornate description of ruins and weather, slow accumulation of dread, the supernatural treated with restraint."),
    ("plain-realist", "Plain realism", ("Mark Twain", "Jack London", "Stephen Crane"), "Write in plain American realism: short concrete sentences, dialogue-forward scenes, vernacular speech where appropriate, no ornamental diction, physical action over interiority."),
    ("modernist-spare", "Modernist spare", ("James Joyce", "Sherwood Anderson", "Ring Lardner"), "Write in the spare modernist mode: declarative sentences, paratactic rhythm, ellipsis and implication over explanation, ordinary objects carrying weight, restrained dialogue."),
)

AXES = ("mean_sentence_length_words", "type_token_ratio_chapter_avg", "adverb_ly_density_pct", "commas_per_sentence", "dialogue_paragraph_pct")

# --- End of the fixed values ------------------------------------------------------
