"""The language dimension: ISO 639-3 code, ISO 639-1 code, English name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The languages of ISO 639-1, with codes and names as published in ISO 639-3.
LANGUAGES = [
    ("aar", "aa", "Afar"), ("abk", "ab", "Abkhazian"), ("afr", "af", "Afrikaans"),
    ("aka", "ak", "Akan"), ("amh", "am", "Amharic"), ("ara", "ar", "Arabic"),
    ("arg", "an", "Aragonese"), ("asm", "as", "Assamese"), ("ava", "av", "Avaric"),
    ("ave", "ae", "Avestan"), ("aym", "ay", "Aymara"), ("aze", "az", "Azerbaijani"),
    ("bak", "ba", "Bashkir"), ("bam", "bm", "Bambara"), ("bel", "be", "Belarusian"),
    ("ben", "bn", "Bengali"), ("bis", "bi", "Bislama"), ("bod", "bo", "Tibetan"),
    ("bos", "bs", "Bosnian"), ("bre", "br", "Breton"), ("bul", "bg", "Bulgarian"),
    ("cat", "ca", "Catalan"), ("ces", "cs", "Czech"), ("cha", "ch", "Chamorro"),
    ("che", "ce", "Chechen"), ("chu", "cu", "Church Slavic"), ("chv", "cv", "Chuvash"),
    ("cor", "kw", "Cornish"), ("cos", "co", "Corsican"), ("cre", "cr", "Cree"),
    ("cym", "cy", "Welsh"), ("dan", "da", "Danish"), ("deu", "de", "German"),
    ("div", "dv", "Dhivehi"), ("dzo", "dz", "Dzongkha"), ("ell", "el", "Modern Greek (1453-)"),
    ("eng", "en", "English"), ("epo", "eo", "Esperanto"), ("est", "et", "Estonian"),
    ("eus", "eu", "Basque"), ("ewe", "ee", "Ewe"), ("fao", "fo", "Faroese"),
    ("fas", "fa", "Persian"), ("fij", "fj", "Fijian"), ("fin", "fi", "Finnish"),
    ("fra", "fr", "French"), ("fry", "fy", "Western Frisian"), ("ful", "ff", "Fulah"),
    ("gla", "gd", "Scottish Gaelic"), ("gle", "ga", "Irish"), ("glg", "gl", "Galician"),
    ("glv", "gv", "Manx"), ("grn", "gn", "Guarani"), ("guj", "gu", "Gujarati"),
    ("hat", "ht", "Haitian"), ("hau", "ha", "Hausa"), ("heb", "he", "Hebrew"),
    ("her", "hz", "Herero"), ("hin", "hi", "Hindi"), ("hmo", "ho", "Hiri Motu"),
    ("hrv", "hr", "Croatian"), ("hun", "hu", "Hungarian"), ("hye", "hy", "Armenian"),
    ("ibo", "ig", "Igbo"), ("ido", "io", "Ido"), ("iii", "ii", "Sichuan Yi"),
    ("iku", "iu", "Inuktitut"), ("ile", "ie", "Interlingue"),
    ("ina", "ia", "Interlingua (International Auxiliary Language Association)"),
    ("ind", "id", "Indonesian"), ("ipk", "ik", "Inupiaq"), ("isl", "is", "Icelandic"),
    ("ita", "it", "Italian"), ("jav", "jv", "Javanese"), ("jpn", "ja", "Japanese"),
    ("kal", "kl", "Kalaallisut"), ("kan", "kn", "Kannada"), ("kas", "ks", "Kashmiri"),
    ("kat", "ka", "Georgian"), ("kau", "kr", "Kanuri"), ("kaz", "kk", "Kazakh"),
    ("khm", "km", "Khmer"), ("kik", "ki", "Kikuyu"), ("kin", "rw", "Kinyarwanda"),
    ("kir", "ky", "Kirghiz"), ("kom", "kv", "Komi"), ("kon", "kg", "Kongo"),
    ("kor", "ko", "Korean"), ("kua", "kj", "Kuanyama"), ("kur", "ku", "Kurdish"),
    ("lao", "lo", "Lao"), ("lat", "la", "Latin"), ("lav", "lv", "Latvian"),
    ("lim", "li", "Limburgan"), ("lin", "ln", "Lingala"), ("lit", "lt", "Lithuanian"),
    ("ltz", "lb", "Luxembourgish"), ("lub", "lu", "Luba-Katanga"), ("lug", "lg", "Ganda"),
    ("mah", "mh", "Marshallese"), ("mal", "ml", "Malayalam"), ("mar", "mr", "Marathi"),
    ("mkd", "mk", "Macedonian"), ("mlg", "mg", "Malagasy"), ("mlt", "mt", "Maltese"),
    ("mon", "mn", "Mongolian"), ("mri", "mi", "Maori"), ("msa", "ms", "Malay (macrolanguage)"),
    ("mya", "my", "Burmese"), ("nau", "na", "Nauru"), ("nav", "nv", "Navajo"),
    ("nbl", "nr", "South Ndebele"), ("nde", "nd", "North Ndebele"), ("ndo", "ng", "Ndonga"),
    ("nep", "ne", "Nepali (macrolanguage)"), ("nld", "nl", "Dutch"),
    ("nno", "nn", "Norwegian Nynorsk"), ("nob", "nb", "Norwegian Bokmål"),
    ("nor", "no", "Norwegian"), ("nya", "ny", "Nyanja"), ("oci", "oc", "Occitan (post 1500)"),
    ("oji", "oj", "Ojibwa"), ("ori", "or", "Oriya (macrolanguage)"), ("orm", "om", "Oromo"),
    ("oss", "os", "Ossetian"), ("pan", "pa", "Panjabi"), ("pli", "pi", "Pali"),
    ("pol", "pl", "Polish"), ("por", "pt", "Portuguese"), ("pus", "ps", "Pushto"),
    ("que", "qu", "Quechua"), ("roh", "rm", "Romansh"), ("ron", "ro", "Romanian"),
    ("run", "rn", "Rundi"), ("rus", "ru", "Russian"), ("sag", "sg", "Sango"),
    ("san", "sa", "Sanskrit"), ("sin", "si", "Sinhala"), ("slk", "sk", "Slovak"),
    ("slv", "sl", "Slovenian"), ("sme", "se", "Northern Sami"), ("smo", "sm", "Samoan"),
    ("sna", "sn", "Shona"), ("snd", "sd", "Sindhi"), ("som", "so", "Somali"),
    ("sot", "st", "Southern Sotho"), ("spa", "es", "Spanish"), ("sqi", "sq", "Albanian"),
    ("srd", "sc", "Sardinian"), ("srp", "sr", "Serbian"), ("ssw", "ss", "Swati"),
    ("sun", "su", "Sundanese"), ("swa", "sw", "Swahili (macrolanguage)"), ("swe", "sv", "Swedish"),
    ("tah", "ty", "Tahitian"), ("tam", "ta", "Tamil"), ("tat", "tt", "Tatar"),
    ("tel", "te", "Telugu"), ("tgk", "tg", "Tajik"), ("tgl", "tl", "Tagalog"),
    ("tha", "th", "Thai"), ("tir", "ti", "Tigrinya"), ("ton", "to", "Tonga (Tonga Islands)"),
    ("tsn", "tn", "Tswana"), ("tso", "ts", "Tsonga"), ("tuk", "tk", "Turkmen"),
    ("tur", "tr", "Turkish"), ("twi", "tw", "Twi"), ("uig", "ug", "Uighur"),
    ("ukr", "uk", "Ukrainian"), ("urd", "ur", "Urdu"), ("uzb", "uz", "Uzbek"),
    ("ven", "ve", "Venda"), ("vie", "vi", "Vietnamese"), ("vol", "vo", "Volapük"),
    ("wln", "wa", "Walloon"), ("wol", "wo", "Wolof"), ("xho", "xh", "Xhosa"),
    ("yid", "yi", "Yiddish"), ("yor", "yo", "Yoruba"), ("zha", "za", "Zhuang"),
    ("zho", "zh", "Chinese"), ("zul", "zu", "Zulu"),
]

MAX_BROADCAST_LANGUAGES = 20_000  # the whole of ISO 639-3 has about 8,000 codes


def from_iso_codes(spark: SparkSession, path: str) -> DataFrame:
    """(alpha_3, alpha_2, name) of all of ISO 639-3, from the JSON form in which the public
    iso-codes project publishes it (``iso_639-3.json``); alpha_2 is null for most."""
    fields = "array<struct<alpha_3: string, alpha_2: string, name: string>>"
    listed = spark.read.schema(f"`639-3` {fields}").json(path, multiLine=True)
    return listed.select(F.inline("639-3"))


class Languages:
    """The known languages, as a small checked dimension.

    ``Languages(spark)`` holds the languages of ISO 639-1; ``Languages(spark, table)`` takes any
    (alpha_3, alpha_2, name) table, such as the whole of ISO 639-3 (see ``from_iso_codes``).
    """

    def __init__(self, spark: SparkSession, table: DataFrame | None = None):
        self.spark = spark
        if table is None:
            # a VALUES list is part of the plan: using it costs no job
            values = ", ".join(f"('{a}', '{b}', '{name}')" for a, b, name in LANGUAGES)
            table = spark.sql(f"SELECT * FROM VALUES {values} AS t(alpha_3, alpha_2, name)")
            self.small = len(LANGUAGES) <= MAX_BROADCAST_LANGUAGES
        else:
            table = table.dropDuplicates(["alpha_3"])  # a join must not multiply rows
            probe = table.select("alpha_3").limit(MAX_BROADCAST_LANGUAGES + 1).count()
            self.small = probe <= MAX_BROADCAST_LANGUAGES
        self.table = table

    def side(self, *columns: str) -> DataFrame:
        """The dimension as a join side, broadcast only while its checked size allows."""
        df = self.table.select(*columns)
        return F.broadcast(df) if self.small else df

    def known(self, df: DataFrame, *codes: str) -> DataFrame:
        """Rows whose every code is in the list."""
        for code in codes:
            side = self.side("alpha_3").withColumnRenamed("alpha_3", "_code")
            df = df.join(side, df[code] == side["_code"], "left_semi")
        return df

    def flag(self, df: DataFrame, code: str | Column, flag: str) -> DataFrame:
        """Adds a boolean column: is the code in the list (false for null)."""
        side = self.side("alpha_3").select(F.col("alpha_3").alias("_code"))
        value = F.col(code) if isinstance(code, str) else code
        out = df.join(side, value == side["_code"], "left")
        return out.withColumn(flag, F.col("_code").isNotNull()).drop("_code")

    def named(self, df: DataFrame, code: str, name: str) -> DataFrame:
        """Adds the English name of a code; null where the code is unknown."""
        side = self.side("alpha_3", "name").select(
            F.col("alpha_3").alias("_code"), F.col("name").alias(name)
        )
        return df.join(side, df[code] == side["_code"], "left").drop("_code")
