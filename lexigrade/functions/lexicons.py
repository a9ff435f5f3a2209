"""Word lists, weights and thresholds that results depend on."""

from __future__ import annotations

# --- fixed values ---------------------------------------------------------------------

SUBORDINATORS = "which that if unless when whenever because although though whereas whether while until".split()
NEGATIONS = "not n't no never none nothing nobody nowhere neither nor cannot without".split()
REFERENCES = "it its this that these those they them".split()
MINOR_WORDS = "a an and for in of on the to".split()
KNOWN_ACRONYMS = (
    "API ASCII AST AWS CI CLI CPU CRUD CSS CSV DB DNS DOM FIXME GB GPU HTML HTTP HTTPS ID IO IP JSON JWT KB MB NOTE OK OS PDF PR "
    "RAM REST SDK SQL SSH SSL TCP TLS TODO UDP UI URI URL USB UTC UTF UUID UX XML XXX YAML"
).split()
FILLER = (
    "a all an and any are as at be been by corresponding current each for from function given helper if in instance into is it its "
    "just method new number object of on or provided simply specified that the these this those to was with"
).split()
CANONICAL = (
    dict.fromkeys("return fetch retrieve obtain read load".split(), "get")
    | dict.fromkeys("update assign store".split(), "set")
    | dict.fromkeys("make build construct".split(), "create")
    | dict.fromkeys("remove destroy erase".split(), "delete")
    | dict(
        max="maximum", min="minimum", num="number", init="initialize", config="configuration", param="parameter", arg="argument",
        info="information", len="length", msg="message", err="error", ctx="context", idx="index", db="database", req="request",
        res="response", cb="callback",
    )
)
PROSE_WORDS = (
    "iOS iPadOS macOS watchOS tvOS iPhone iPad eBay JavaScript TypeScript CoffeeScript GitHub GitLab PostgreSQL MySQL SQLite NoSQL "
    "OAuth WebSocket WebAssembly YouTube PowerShell DevOps"
).split()

#: (metric, fitted weight, prior weight, easy, hard, ramped by length), in scoring order.
WEIGHTS = [
    ("nounStack", 1.042, 1.0, 2.0, 5.0, False),
    ("clauseCount", 1.079, 1.0, 2.0, 5.0, False),
    ("meanZipf", 0.889, 1.0, 5.5, 3.5, False),
    ("minZipf", 1.222, 1.5, 4.0, 2.0, False),
    ("lexicalDensity", 0.365, 0.5, 0.5, 0.85, False),
    ("negationCount", 1.072, 1.0, 0.0, 3.0, False),
    ("danglingReference", 1.032, 1.0, 0.0, 2.0, False),
    ("undefinedAcronyms", 1.485, 1.5, 0.0, 2.0, False),
    ("commentLength", 1.158, 1.0, 10.0, 60.0, False),
    ("fleschKincaidGrade", 1.014, 1.0, 8.0, 16.0, True),
    ("gunningFog", 1.051, 1.0, 8.0, 16.0, True),
    ("colemanLiau", 1.025, 1.0, 8.0, 16.0, True),
    ("averageSentenceLength", 0.993, 1.0, 15.0, 30.0, True),
]
BAND_OK, BAND_HARD = 1.08, 4.128
RAMP_START, RAMP_END = 20, 40
MIN_WORDS, TOP_REASONS, LENS_REASONS, EXCERPT = 3, 3, 2, 80
UNLISTED_ZIPF, COMMON_ZIPF = 2.0, 7.0
REDUNDANCY_THRESHOLD = 0.75
MAX_VOCABULARY, MAX_FILES, MAX_FILE_BYTES = 20_000, 5_000, 1_000_000

# --- our own: the closed-class lexicon and suffix rules of the tagger -------------------

POS_WORDS = {
    "DET": "the a an this that these those each every some any no all both either neither another such".split(),
    "PRON": "it its they them he she him her his we us our you your i me my who whom whose which what itself themselves something anything nothing everything one".split(),
    "AUX": "is are was were be been being am has have had do does did can could may might must shall should will would cannot 's 're 've 'll 'd 'm".split(),
    "PART": "to not n't".split(),
    "ADP": "of in on at by for from with without into onto over under between through during before after about against within upon via per as".split(),
    "CCONJ": "and or but nor yet plus".split(),
    "SCONJ": "if unless when whenever because although though whereas whether while until since than".split(),
    "ADV": "very too also only just never always often here there then now still again already almost not soon how why where so".split(),
    "VERB": "get gets got set sets make makes made use uses used take takes took give gives return returns call calls run runs see go goes find finds keep keeps let lets need needs want send sends read reads write writes add adds build builds check checks parse parses handle handles fall falls skip skips retry retries know hold holds drop drops".split(),
    "NUM": "two three four five six seven eight nine ten hundred thousand million".split(),
    "INTJ": "yes please oh".split(),
}
POS_SUFFIXES = [
    ("ADV", r"..ly$"),
    ("VERB", r"(?:..ize|..izes|..ized|..ise|..ify|..ifies|...ing|...ed)$"),
    ("ADJ", r"(?:..ous|..ful|..able|..ible|...al|...ive|...ic|..less|...ary|...ish|...ent|...ant)$"),
]
WORD_TAGS = "ADJ ADP ADV AUX CCONJ DET INTJ NOUN NUM PART PRON PROPN SCONJ VERB".split()
CONTENT_TAGS = "NOUN PROPN VERB ADJ ADV".split()
SYLLABLE_EXTRA = "recipe recipes idea ideas area areas being create creates".split()
