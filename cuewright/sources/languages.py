"""Languages that speech models know, and codes for what users write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Codes and names.
PAIRS = [
    ("en", "English"), ("zh", "Chinese"), ("de", "German"), ("es", "Spanish"), ("ru", "Russian"), ("ko", "Korean"), ("fr", "French"),
    ("ja", "Japanese"), ("pt", "Portuguese"), ("tr", "Turkish"), ("pl", "Polish"), ("ca", "Catalan"), ("nl", "Dutch"), ("ar", "Arabic"),
    ("sv", "Swedish"), ("it", "Italian"), ("id", "Indonesian"), ("hi", "Hindi"), ("fi", "Finnish"), ("vi", "Vietnamese"), ("he", "Hebrew"),
    ("uk", "Ukrainian"), ("el", "Greek"), ("ms", "Malay"), ("cs", "Czech"), ("ro", "Romanian"), ("da", "Danish"), ("hu", "Hungarian"),
    ("ta", "Tamil"), ("no", "Norwegian"), ("th", "Thai"), ("ur", "Urdu"), ("hr", "Croatian"), ("bg", "Bulgarian"), ("lt", "Lithuanian"),
    ("la", "Latin"), ("mi", "Maori"), ("ml", "Malayalam"), ("cy", "Welsh"), ("sk", "Slovak"), ("te", "Telugu"), ("fa", "Persian"), ("lv", "Latvian"),
    ("bn", "Bengali"), ("sr", "Serbian"), ("az", "Azerbaijani"), ("sl", "Slovenian"), ("kn", "Kannada"), ("et", "Estonian"), ("mk", "Macedonian"),
    ("br", "Breton"), ("eu", "Basque"), ("is", "Icelandic"), ("hy", "Armenian"), ("ne", "Nepali"), ("mn", "Mongolian"), ("bs", "Bosnian"),
    ("kk", "Kazakh"), ("sq", "Albanian"), ("sw", "Swahili"), ("gl", "Galician"), ("mr", "Marathi"), ("pa", "Punjabi"), ("si", "Sinhala"),
    ("km", "Khmer"), ("sn", "Shona"), ("yo", "Yoruba"), ("so", "Somali"), ("af", "Afrikaans"), ("oc", "Occitan"), ("ka", "Georgian"),
    ("be", "Belarusian"), ("tg", "Tajik"), ("sd", "Sindhi"), ("gu", "Gujarati"), ("am", "Amharic"), ("yi", "Yiddish"), ("lo", "Lao"), ("uz", "Uzbek"),
    ("fo", "Faroese"), ("ht", "Haitian Creole"), ("ps", "Pashto"), ("tk", "Turkmen"), ("nn", "Nynorsk"), ("mt", "Maltese"), ("sa", "Sanskrit"),
    ("lb", "Luxembourgish"), ("my", "Myanmar"), ("bo", "Tibetan"), ("tl", "Tagalog"), ("mg", "Malagasy"), ("as", "Assamese"), ("tt", "Tatar"),
    ("haw", "Hawaiian"), ("ln", "Lingala"), ("ha", "Hausa"), ("ba", "Bashkir"), ("jw", "Javanese"), ("su", "Sundanese"), ("yue", "Cantonese"),
]


def languages(spark: SparkSession) -> DataFrame:
    """(code, name) of all languages."""
    return spark.createDataFrame(PAIRS, "code string, name string")


def language_code(value: Column) -> Column:
    """The code of a code or name in any case; null for none, '', auto and automatic; else the lower-cased value. A literal map, no join."""
    known = F.lower(F.trim(value))
    entries = [F.lit(x) for code, name in PAIRS for x in (name.lower(), code)]
    codes = F.create_map(*entries)
    return F.when(value.isNotNull() & ~known.isin("", "auto", "automatic"), F.coalesce(F.try_element_at(codes, known), known))
