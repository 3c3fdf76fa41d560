"""Parameters and closed word lists of the document operators."""

from __future__ import annotations

# Results depend on each of them, so they are stated as they must be and in their usual order.
BM25_K1, BM25_B = 1.5, 0.75
RRF_K = 60
CHUNKS_KEPT = 8
MIN_CONFIDENCE, MIN_GAP, NAMED_FLOOR = 0.5, 0.15, 0.4
AMENDMENT_SHARE, MAX_AMENDMENTS = 0.3, 2
FORM_SHARE, FORM_MAX_PAGES, FORM_MIN_ROWS = 0.4, 10, 3
LABEL_MAX, VALUE_MAX, BARE_MAX, JOINED_MAX, PROSE_MIN = 40, 60, 60, 120, 60
MIN_SCORE, MAX_OVERLAP, COVERED, CHECK_SCORE, CHECK_COUNT = 0.2, 0.6, 0.5, 0.3, 3
TILE_OVERLAP, EDGE, EDGE_SHARE = 0.12, 4.0, 0.5
CELL_GAP, PARAGRAPH_GAP = 1.5, 0.9
SHORTLIST = {"text": 5, "tick": 3, "choice": 1}
TOOL_LABEL_MAX = 60
REFUSE_BELOW, LANGUAGE_SAMPLE, SCRIPT_CONFIDENCE = 0.2, 3000, 1.0
BATCH_INPUTS, BATCH_TOKENS = 16, 4096
DEFAULT_HEIGHT = 10.0

STOP_WORDS = (
    "the", "is", "was", "what", "who", "how", "of", "and", "to", "in", "does", "can", "which", "when", "are", "for", "a", "an", "der", "das", "und", "ist", "wie",
    "welche", "welcher", "darf", "hoch", "kostet", "ein", "eine", "wer", "wann", "muss", "nicht", "mit", "dem", "den", "des", "zu", "auf", "für", "von", "beträgt",
    "wird", "sind", "oder", "gefunden", "be", "it", "this", "that", "by", "with", "at", "per", "from", "as", "or", "on", "any", "all", "shall", "must",
)
SUFFIXES = ("ting", "ing", "ies", "es", "ed", "s")
AMENDMENT = "amend|nachtrag|änderung|ab dem|with effect|effective|الحاقیه|اصلاحیه|ملحق|اعتباراً|تعديل"
GERMAN = ("der", "die", "das", "und", "ist", "nicht", "mit", "für", "von", "zu", "den", "des", "ein", "eine")
ENGLISH = ("the", "and", "of", "to", "is", "in", "for", "with", "by", "be", "this", "that", "shall")
#: Words of a question that ask and name nothing.
ASKING = (
    "what", "which", "when", "where", "who", "whom", "whose", "how", "much", "many", "does", "did", "the", "and", "for", "are", "was", "were", "this", "that", "with",
    "from", "will", "should", "have", "has", "can", "wie", "wann", "wer", "welche", "welcher", "welches", "lautet", "ist", "sind", "der", "die", "das", "den", "dem",
    "des", "und", "hat", "soll", "wird", "viel", "viele", "für", "von", "mit", "چه", "چیست", "کدام", "چند", "است", "این", "متى", "أين", "كم", "على",
)
BULLETS = "•●▪◦‣∙■□✓✔➢➤►Øçüv"
ABBREVIATIONS = (
    "No", "Nr", "Abs", "Art", "bzw", "ca", "Dr", "Prof", "Mr", "Mrs", "Ms", "St", "Jr", "Sr", "vs", "Vol", "Fig", "Figs", "Eq", "Ref", "Refs", "al", "approx",
    "Abb", "Kap", "vgl", "evtl", "ggf", "inkl", "zzgl", "Tel", "Str", "Mio", "Mrd", "Tsd", "Jh",
)
#: Empty fill-in lines; leaders of single dots with blanks stay.
FILL_IN = r"[_.]*_{2,}[_.]*|\.{4,}"
#: A numbered label: digits and full stops, then a blank. Dates and telephone numbers are none.
NUMBERED = r"^\d+\.(\d+\.?)*\s"
#: Arabic vowel marks and annotation signs.
MARKS = (("064B", "065F"), ("0670", "0670"), ("06D6", "06ED"))
RTL = (("0590", "08FF"), ("FB1D", "FDFF"), ("FE70", "FEFF"))
OCR_RTL = (("0600", "06FF"), ("0750", "077F"), ("FB50", "FEFF"))
LEADERS = ".…·_"
BOX_GLYPHS = "□☐☑☒■▢◻❏○●◯⊠"
#: How much a text counts by where it stands; places that are not named count in full.
PLACE_WEIGHTS = {
    "tick": {"left": 0.95, "above": 0.9, "inside": 0.9, "below": 0.85},
    "text": {"below": 0.9, "right": 0.85},
    "choice": {"below": 0.9, "right": 0.85},
}
GENERIC_TOOLTIPS = ("text", "textfeld", "check box", "checkbox", "kontrollk", "topmostsubform", "formular", "field", "feld", "untitled", "undefined")
LABEL_FILLERS = ("the", "my", "our", "a", "an", "is", "are", "was", "of", "for")
PART_FILLERS = ("the", "my", "our", "is", "are", "was", "of", "to", "a", "an")
OCR_CODES = {"english": "eng", "german": "deu", "persian": "fas", "arabic": "ara"}
SCRIPT_LANGUAGES = {"Latin": ("english", "german"), "Arabic": ("persian", "arabic")}
#: What a tool-calling model is offered; {} stands for labels, a description and options, each as JSON.
FILL_TOOL = '{"name": "fill_field", "description": "Write a value into a text field of the form.", "parameters": {"type": "object", "properties": {"field": {"type": "string", "enum": [{}], "description": "The field\'s label"}, "value": {"type": "string", "description": "The value to write, copied from the request"}}, "required": ["field", "value"]}}'
TICK_TOOL = '{"name": "set_checkbox", "description": "Tick or untick a checkbox of the form.", "parameters": {"type": "object", "properties": {"field": {"type": "string", "enum": [{}]}, "checked": {"type": "boolean"}}, "required": ["field", "checked"]}}'
CHOICE_TOOL = '{"name": "choose_option", "description": {}, "parameters": {"type": "object", "properties": {"option": {"type": "string", "enum": [{}]}}, "required": ["option"]}}'
NO_TOOL = '{"name": "no_matching_field", "description": "The form has no field for this request, or it is unclear which field is meant.", "parameters": {"type": "object", "properties": {}}}'
UNSUPPORTED = "signatures are added with a signing tool, not typed"
