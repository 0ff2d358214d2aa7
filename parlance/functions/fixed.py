"""Dictionaries and limits that results depend on."""

# ISO codes and English names of the accepted languages.
LANGUAGES = {
    "en": "english", "zh": "chinese", "de": "german", "es": "spanish", "ru": "russian",
    "ko": "korean", "fr": "french", "ja": "japanese", "pt": "portuguese", "tr": "turkish",
    "pl": "polish", "ca": "catalan", "nl": "dutch", "ar": "arabic", "sv": "swedish",
    "it": "italian", "id": "indonesian", "hi": "hindi", "fi": "finnish", "vi": "vietnamese",
    "he": "hebrew", "uk": "ukrainian", "el": "greek", "ms": "malay", "cs": "czech",
    "ro": "romanian", "da": "danish", "hu": "hungarian", "ta": "tamil", "no": "norwegian",
    "th": "thai", "ur": "urdu", "hr": "croatian", "bg": "bulgarian", "lt": "lithuanian",
    "la": "latin", "mi": "maori", "ml": "malayalam", "cy": "welsh", "sk": "slovak",
    "te": "telugu", "fa": "persian", "lv": "latvian", "bn": "bengali", "sr": "serbian",
    "az": "azerbaijani", "sl": "slovenian", "kn": "kannada", "et": "estonian", "mk": "macedonian",
    "br": "breton", "eu": "basque", "is": "icelandic", "hy": "armenian", "ne": "nepali",
    "mn": "mongolian", "bs": "bosnian", "kk": "kazakh", "sq": "albanian", "sw": "swahili",
    "gl": "galician", "mr": "marathi", "pa": "punjabi", "si": "sinhala", "km": "khmer",
    "sn": "shona", "yo": "yoruba", "so": "somali", "af": "afrikaans", "oc": "occitan",
    "ka": "georgian", "be": "belarusian", "tg": "tajik", "sd": "sindhi", "gu": "gujarati",
    "am": "amharic", "yi": "yiddish", "lo": "lao", "uz": "uzbek", "fo": "faroese",
    "ht": "haitian creole", "ps": "pashto", "tk": "turkmen", "nn": "nynorsk", "mt": "maltese",
    "sa": "sanskrit", "lb": "luxembourgish", "my": "myanmar", "bo": "tibetan", "tl": "tagalog",
    "mg": "malagasy", "as": "assamese", "tt": "tatar", "haw": "hawaiian", "ln": "lingala",
    "ha": "hausa", "ba": "bashkir", "jw": "javanese", "su": "sundanese", "yue": "cantonese",
}

# Languages that have a forced-alignment model, and that model's public name.
ALIGNMENT_MODELS = {
    "en": "WAV2VEC2_ASR_BASE_960H",
    "fr": "VOXPOPULI_ASR_BASE_10K_FR",
    "de": "VOXPOPULI_ASR_BASE_10K_DE",
    "es": "VOXPOPULI_ASR_BASE_10K_ES",
    "it": "VOXPOPULI_ASR_BASE_10K_IT",
    "pt": "jonatasgrosman/wav2vec2-large-xlsr-53-portuguese",
    "nl": "jonatasgrosman/wav2vec2-large-xlsr-53-dutch",
    "pl": "jonatasgrosman/wav2vec2-large-xlsr-53-polish",
    "fi": "jonatasgrosman/wav2vec2-large-xlsr-53-finnish",
    "hu": "jonatasgrosman/wav2vec2-large-xlsr-53-hungarian",
    "el": "jonatasgrosman/wav2vec2-large-xlsr-53-greek",
    "fa": "jonatasgrosman/wav2vec2-large-xlsr-53-persian",
    "ar": "jonatasgrosman/wav2vec2-large-xlsr-53-arabic",
    "ru": "jonatasgrosman/wav2vec2-large-xlsr-53-russian",
    "uk": "Yehor/wav2vec2-xls-r-300m-uk-with-small-lm",
    "ja": "jonatasgrosman/wav2vec2-large-xlsr-53-japanese",
    "zh": "jonatasgrosman/wav2vec2-large-xlsr-53-chinese-zh-cn",
    "vi": "nguyenvulebinh/wav2vec2-base-vietnamese-250h",
}

# Month names.
MONTHS = {
    "en": ["january", "february", "march", "april", "may", "june", "july", "august",
           "september", "october", "november", "december"],
    "fr": ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août",
           "septembre", "octobre", "novembre", "décembre"],
}

# Currency signs that follow an amount.
CURRENCIES = ["€", "$", "£", "¥"]

# Symbols and their words, in replacement order.
SYMBOLS = {
    "en": [
        ("%", "percent"), ("÷", "divided by"), ("*", "times"), ("×", "times"),
        ("±", "plus or minus"), ("+", "plus"), ("&", "and"), ("@", "at"),
        ("m²", "square meters"), ("m³", "cubic meters"), ("²", "squared"), ("³", "cubed"),
        ("¼", "one quarter"), ("½", "one half"), ("¾", "three quarters"), ("§", "section"),
        ("°C", "degrees Celsius"), ("°F", "degrees Fahrenheit"), ("°K", "kelvins"), ("°", "degrees"),
        ("€", "euros"), ("¢", "cents"), ("$", "dollars"), ("£", "pounds"), ("¥", "yens"),
    ],
    "fr": [
        ("%", "pour cents"), ("÷", "divisé par"), ("*", "fois"), ("×", "fois"),
        ("±", "plus ou moins"), ("+", "plus"), ("&", "et"), ("@", "arobase"),
        ("m²", "mètres carrés"), ("m³", "mètres cubes"), ("²", "au carré"), ("³", "au cube"),
        ("¼", "un quart"), ("½", "un demi"), ("¾", "trois quarts"), ("§", "section"),
        ("°C", "degrés Celsius"), ("°F", "degrés Fahrenheit"), ("°K", "kelvins"), ("°", "degrés"),
        ("€", "euros"), ("¢", "cents"), ("$", "dollars"), ("£", "livres"), ("¥", "yens"),
    ],
}

# Filler words.
DISFLUENCIES = {"fr": ["euh", "heu"]}

# Single marks that the punctuation labels can produce.
MAPPED_PUNCTUATION = '.,;:()?!，！？；：（）［］【】└_。、…—「」．《》“”"〉〈↑〔〕'

# Text printed for punctuation labels 0..4.
PUNCTUATION_MARKS = ["", ",", ".", " ?", " !"]

GLUE_CHARS = "'-&@.,"

# ASCII punctuation.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Fractions with words of their own.
DENOMINATORS = {
    "fr": {"2": "demi", "3": "tiers", "4": "quart"},
    "en": {"2": "half", "4": "quarter"},
    "es": {"2": "mitad", "3": "tercio"},
}

# Default parameters (seconds unless named otherwise).
SAMPLE_RATE = 16000
ENERGY_THRESHOLD_DB = 50
LONG_FILE_THRESHOLD_S, LONG_FILE_CHUNK_S, LONG_FILE_CONTEXT_S = 540, 360, 5
MIN_CHUNK_S = 0.5
SILENCE_TIMEOUT_FACTOR = 1.5
MAX_WORDS_IN_BUFFER = 5
PARTIALS_PER_SECOND = 4
PAUSE_FOR_FINAL_S = 2.0
BUFFER_TRIMMING_S = 8.0
IDLE_TIMEOUT_S = 10
PROMPT_CHARS = 200
