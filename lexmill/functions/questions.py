"""What a question is about: spelling, topics, intents, scope and rewrites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import nfkc

#: Misspelt words, topics and intents with what points to them, abbreviations, words of the domain.
TYPOS = {"kompenasasi": "kompensasi", "kompesasi": "kompensasi", "konpensasi": "kompensasi", "karywan": "karyawan", "kryawan": "karyawan", "tunjagan": "tunjangan", "pesangoon": "pesangon", "jamian": "jaminan", "peraturaan": "peraturan", "kesehatn": "kesehatan", "keselamtan": "keselamatan"}
TOPICS = {
    "pkwt": "pkwt|kontrak|perjanjian kerja waktu tertentu|kompensasi|uang kompensasi|fixed-term contract|fixed term contract|fixed-term worker|fixed term worker|contract worker",
    "phk": "phk|pemutusan hubungan kerja|pesangon|uang pisah|mengundurkan diri|pengunduran diri|resign|resignation|surat peringatan|skorsing|termination|dismissal|severance|warning letter",
    "thr": "thr|tunjangan hari raya|religious holiday allowance",
    "pengupahan": "upah|gaji|upah minimum|umk|ump|lembur|wage|salary|minimum wage|overtime",
    "bpjs": "bpjs|jht|jkp|jkk|jkm|jp|jaminan sosial|jaminan pensiun|usia pensiun|pensiun|employment social security|pension|retirement",
    "k3": "k3|keselamatan kerja|kesehatan kerja|p2k3|smk3|bahaya|kecelakaan kerja|occupational safety|occupational health|workplace safety|workplace hazard",
    "serikat_pekerja": "serikat pekerja|serikat buruh|trade union|labor union",
    "hubungan_industrial": "hubungan industrial|perselisihan|mogok|pemogokan|bipartit|tripartit|mediasi|konsiliasi|arbitrase|phi|industrial relations|labor dispute|labour dispute|strike",
    "alih_daya": "alih daya|outsourcing",
    "tenaga_kerja_asing": "tka|tenaga kerja asing|foreign worker",
    "waktu_kerja": "waktu kerja|jam kerja|jam normal|waktu istirahat|istirahat|lembur|cuti|working hours|overtime|leave",
}
INTENTS = {
    "definition": "apa itu|apa yang dimaksud|definisi|pengertian|maksud dari|jelaskan|what is|definition",
    "duration": "berapa lama|durasi|jangka waktu|batas maksimal|how long",
    "eligibility": "siapa yang berhak|berhak|syarat|who is eligible|eligible",
    "procedure": "cara|prosedur|bagaimana|how to|procedure",
    "comparison": "perbedaan|beda|bandingkan|difference|compare",
    "calculation": "hitung|perhitungan|berapa besar|berapa|calculate|how much",
    "status": "berlaku|dicabut|diubah|status|in force|revoked|amended",
}
ABBREVIATIONS = {"pkwt": "perjanjian kerja waktu tertentu", "pkwtt": "perjanjian kerja waktu tidak tertentu", "phk": "pemutusan hubungan kerja", "thr": "tunjangan hari raya", "jht": "jaminan hari tua", "jkp": "jaminan kehilangan pekerjaan", "jkk": "jaminan kecelakaan kerja", "jkm": "jaminan kematian", "jp": "jaminan pensiun", "k3": "keselamatan dan kesehatan kerja", "p2k3": "panitia pembina keselamatan dan kesehatan kerja", "smk3": "sistem manajemen keselamatan dan kesehatan kerja", "phi": "pengadilan hubungan industrial"}
DOMAIN = "pekerja|karyawan|buruh|pengusaha|ketenagakerjaan|hubungan kerja|perusahaan|kontrak kerja|cuti|lembur|jam kerja|magang|pemagangan|apprenticeship|internship|permenaker|worker|employee|employer|employment|labor law|labour law|workplace|leave entitlement|overtime|working hours"
PREFIXES = ("dalam hubungan kerja, ", "untuk pekerja perusahaan swasta, ", "menurut ketentuan yang berlaku, ", "dalam kondisi umum, ")
PAYMENT = "bayar|gaji|upah|thr|kompensasi|pesangon|denda|tunjangan|iuran"
ENDING = r"\b(berakhir|diputus|tamat|habis)|putus hubungan|pemutusan hubungan|habis kontrak|tamat kontrak|berakhir kontrak|selesai kontrak"
COMPARED = r"(?:perbedaan|bandingkan|beda)\s+(.+?)\s+(?:dan|dengan)\s+(.+?)(?:[?]|$)"
PAID_LATE = " paling lambat wajib dibayarkan sebelum batas waktu pembayaran"
PAID_BY = " statutory payment deadline no later than due date"
ENDED = "berakhirnya PKWT uang kompensasi Pasal 15 16 17 PP 35 Tahun 2021 pemutusan hubungan kerja pesangon Pasal 40 43 UU 13 Tahun 2003"


def normal_question(text: Column) -> Column:
    """Compatibility form, lower case, white space collapsed, known misspellings of whole words mended."""
    out = F.trim(F.regexp_replace(F.lower(nfkc(text)), r"(?U)\s+", " "))
    for wrong, right in TYPOS.items():
        out = F.regexp_replace(out, rf"(?U)\b{wrong}\b", right)
    return out


def named(question: Column, dictionary: dict[str, str]) -> Column:
    """Names whose words (separated by |) the question contains, in the dictionary's order. Null: none."""
    found = [F.when(F.coalesce(question, F.lit("")).rlike(words), F.lit(name)) for name, words in dictionary.items()]
    return F.array_compact(F.array(*found))


def topics(question: Column) -> Column:
    return named(question, TOPICS)


def intents(question: Column) -> Column:
    found = named(question, INTENTS)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general_question")))


def in_scope(question: Column) -> Column:
    """Whether a topic is found, or a word of the domain after one known opening is taken off."""
    bare = F.regexp_replace(F.coalesce(question, F.lit("")), "^(" + "|".join(PREFIXES) + ")", "")
    return (F.size(topics(question)) > 0) | bare.rlike(DOMAIN)


def spelled_out(text: Column) -> Column:
    """Abbreviations that stand as words in full, one after the other."""
    for short, long in ABBREVIATIONS.items():
        text = F.regexp_replace(text, rf"(?U)\b{short}\b", long)
    return text


def rewrites(question: Column, has_regulation: Column | None = None) -> Column:
    """The question and its rewrites, each once, in order: both sides of a comparison, abbreviations in full, the legal name of
    compensation, time limits of payments (two languages), ends of contracts. Null: null.
    """
    full = spelled_out(question)
    probes = []
    sides = [F.regexp_extract(question, COMPARED, k) for k in (1, 2)]
    trimmed = [F.regexp_replace(F.trim(x), r"\?+$", "") for x in sides]
    compared = question.rlike(COMPARED) & (trimmed[0] != "") & (trimmed[1] != "") & (F.length(trimmed[0]) <= 60) & (F.length(trimmed[1]) <= 60)
    for side in trimmed:
        long = spelled_out(side)
        probes.append(F.when(compared, F.concat(F.lit("perbedaan "), F.when(long != side, F.concat(side, F.lit(" "), long)).otherwise(side))))
    paid = F.replace(full, F.lit("kompensasi"), F.lit("uang kompensasi"))
    hinted = F.array_contains(topics(question), "pkwt") & ~(has_regulation if has_regulation is not None else F.lit(False))
    legal = F.when(full.contains("kompensasi") & ~full.contains("uang kompensasi"), F.when(hinted, F.concat(paid, F.lit(" PP 35 Tahun 2021"))).otherwise(paid))
    late = F.when(question.rlike("kapan|batas waktu|tenggat") & full.rlike(PAYMENT), F.concat(full, F.lit(PAID_LATE)))
    due = F.when(question.rlike("when|deadline|due date|latest payment date"), F.concat(full, F.lit(PAID_BY)))
    ends = F.when(full.rlike(ENDING), F.lit(ENDED))
    return F.when(question.isNotNull(), F.array_distinct(F.array_compact(F.array(question, *probes, full, legal, late, due, ends))))


#: Words that tell Indonesian from English.
INDONESIAN = (
    "apa bagaimana gimana kapan dimana mengapa kenapa adakah apakah berapa siapakah siapa kah yang dan atau dalam untuk dengan pada adalah ini itu "
    "dari ke kepada bayar dibayar di tidak bukan belum akan dapat harus wajib hak pekerja perusahaan undang peraturan "
    "pp ppno perppu uu pkwt phk thr bpjs upah gaji denda dendanya pembayaran kompensasi sanksi ketentuan berlaku komplain sanggahan"
).split()
ENGLISH = (
    "what how when where why which who is are was were do does did can could should would may might the "
    "a an and or but in on at to for of with by from this that these those not no yes if then "
    "employment worker employee employer labor labour wage salary contract compensation payment penalty deadline entitlement termination bonus insurance safety"
).split()


def language(text: Column) -> Column:
    """id or en, by which one's words a text has more of; else id for texts beyond ASCII. Null: en."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    hits = lambda known: F.size(F.array_intersect(words, F.array(*map(F.lit, known))))
    more = hits(INDONESIAN) - hits(ENGLISH)
    return F.when(more > 0, "id").when(more < 0, "en").when(text.rlike(r"[^\x00-\x7F]"), "id").otherwise("en")
