"""Word lists, tables and label patterns that decide what a document says.

They are facts about Macedonian invoices and ledger formats, stated as plain text. Anything that
names a company, or that the owner of the books may change, is an input table or a setting instead.
"""

# --- Alphabet ------------------------------------------------------------------------------------

# Macedonian letters and their Latin spelling, in alphabetical order.
_UPPER = [
    ("А", "A"), ("Б", "B"), ("В", "V"), ("Г", "G"), ("Д", "D"), ("Ѓ", "Gj"), ("Е", "E"), ("Ж", "Zh"),
    ("З", "Z"), ("Ѕ", "Dz"), ("И", "I"), ("Ј", "J"), ("К", "K"), ("Л", "L"), ("Љ", "Lj"), ("М", "M"),
    ("Н", "N"), ("Њ", "Nj"), ("О", "O"), ("П", "P"), ("Р", "R"), ("С", "S"), ("Т", "T"), ("Ќ", "Kj"),
    ("У", "U"), ("Ф", "F"), ("Х", "H"), ("Ц", "Ts"), ("Ч", "Ch"), ("Џ", "Dzh"), ("Ш", "Sh"),
]
LATIN_OF_CYRILLIC = _UPPER + [(c.lower(), l.lower()) for c, l in _UPPER]

# Characters a scanner may print for the one on the left.
LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "К": "K", "М": "M", "О": "O", "Р": "P", "Т": "T",
    "Х": "X", "У": "Uy", "П": "nP", "Д": "D",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "п": "n", "к": "k", "н": "hn",
    "A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "K": "К", "M": "М", "O": "О", "P": "Р", "T": "Т",
    "X": "Х", "U": "Уy", "y": "УU", "n": "Пп", "D": "Д",
    "a": "а", "e": "е", "o": "о", "p": "р", "c": "с", "x": "х", "k": "к", "h": "н",
}

# --- Words ---------------------------------------------------------------------------------------

# Legal forms, the capital and trade words that say nothing about who a company is.
LEGAL_FORM_PATTERN = (
    r"\b(?:D?OO|DOOEL|dooел|АД|AD|EAD|ЕОД|EOD|SSD|КД|DOO\s+SKOPJE|Skopje|Скопје|Skopjе"
    r"|eksport|import|ekspor|импорт|извоз|увоз|ekspres|во земјата)\b"
)

# Words that close or mark a company name.
COMPANY_SUFFIXES = [
    "ДОО", "ДООЕЛ", "АД", "АКЦИОНЕРСКО ДРУШТВО",
    "DOO", "DOOEL", "AD", "EOOD", "ЕОД", "СД", "ООД",
    "Ltd", "LLC", "Corp", "Inc", "GmbH",
    "Communications", "Consulting", "Solutions", "Services",
    "Systems", "Technologies", "Technology", "Networks", "Group",
]

# Words of lines that describe the service or product.
DESCRIPTION_KEYWORDS = [
    "услуг", "service", "опис", "предмет", "назив", "description",
    "производ", "product", "наслов", "title",
]

# Words of lines that only round the invoice off.
ROUNDING_KEYWORDS = ["заокружување", "zaokruzuvanje", "zaokruzuv", "rounding"]

# Labels of the vendor's tax number, tried in this order.
VAT_LABELS = ["Единствен даночен број", "ДДВ број", "даночен број", "Даночен број", "ЕДБ"]

# --- Section marks and generated texts --------------------------------------------------------------

ITEMS_MARK = "--- СТАВКИ ---"
TOTALS_MARK = "--- ВКУПНО ---"
FOOTER_MARK = "--- КРАЈ ---"
SYNTHETIC_ITEM = "Услуги / Services"
PAYABLE_TEXT = "Обврска спрема добавувач"
UNKNOWN_VENDOR = "Unknown vendor"
NO_NUMBER = "N/A"

# --- Accounts ------------------------------------------------------------------------------------

DEFAULT_KONTO = "4499"
PAYABLE_KONTO = "2200"
INPUT_VAT_KONTO = "1360"

# Labels of the three accounts that no rule assigns.
OTHER_KONTO_LABELS = {
    PAYABLE_KONTO: PAYABLE_TEXT,
    INPUT_VAT_KONTO: "ДДВ / Input VAT",
    DEFAULT_KONTO: "Останати трошоци на работење",
}

# Account rules for whole documents, first match wins.
DOCUMENT_RULES = [
    ("4030", ["gemak", "evn", "elektr", "struja", "струја", "kwh", "kw/h", "осветлув", "осветување", "дистрибуц", "distribuc",
              "електр", "energie"]),
    ("4031", ["toplin", "toplif", "toplana", "grejanje", "греење", "heating"]),
    ("4032", ["gorivo", "nafta", "benzin", "dizel", "petrol", "fuel", "гориво", "нафта", "бензин"]),
    ("4150", ["komunalec", "vodovod", "voda ", " voda", "water", "водовод", "вода", "канализ"]),
    ("4010", ["kancelariski", "kancelar", "канцелар", "hartija", "paper", "toner", "тонер"]),
    ("4011", ["cistko", "chistko", "^istko", "cleanin", "чистко", "чистење"]),
    ("4110", ["po[tenski", "postensk", "пошт", "makedonska po[ta", "ptt"]),
    ("4111", ["telefonski", "telekomunikac", "a1 mak", "one mak", "телефон", "telefon", "мобил", "mobil",
              "makedonski telekomunikacii"]),
    ("4112", ["internet", "wifi", "broadband", "fiber", "adsl", "интернет"]),
    ("4130", ["odr@uvawe", "odrzuvanje", "одржув", "поправк", "popravk", "tekovno", "investiciono", "maintenance", "servis"]),
    ("4140", ["naemnin", "kirija", "кирија", "закуп", "zakup", "renta", "najem", "leasing", "lizing", "наем"]),
    ("4450", ["osigur", "polisa", "triglav", "uniqa", "grawe", "insurance", "осигур", "полиса"]),
    ("4170", ["reklam", "marketing", "oglas", "реклам", "маркет", "огласув", "propaganda"]),
    ("44905", ["notarski", "нотар", "notary"]),
    ("449051", ["advokat", "правни", "pravni", "legal", "lawyer", "адвокат"]),
    ("44907", ["software", "softver", "licenc", "лиценц", "cloud", "hosting", "saas", "erp", "it uslugi", "it service", "лиценза"]),
    ("44902", ["konsultant", "sovetodav", "smetkovod", "revizija", "reviz", "audit", "консалт", "ревиз", "консултант"]),
    ("4460", ["bankarski", "banking", "banka", "bank ", "provizija", "камата", "kamata", "commission", "банка", "провизија"]),
    ("4109", ["prevoz", "transport", "dostava", "logistik", "freight", "cargo", "delivery", "kurirsk", "куриерск", "достава",
              "превоз", "такси", "taxi"]),
    ("44000", ["hotel", "avion", "airlin", "letov", "dnevnic", "travel", "patuvanj", "хотел", "патувањ", "smestu", "сместув"]),
]

# Account rules for single lines, with the labels of the accounts, first match wins.
LINE_RULES = [
    ("4030", "Електрична енергија", ["gemak", "evn ", "електр", "elektr", "struja", "струја", "kwh", "kw/h", "осветлув",
                                     "осветување", "дистрибуц", "distribuc", "ЕВН"]),
    ("4031", "Топлинска енергија", ["toplin", "toplif", "toplana", "grejanje", "греење", "heating"]),
    ("4032", "Горива", ["gorivo", "nafta", "benzin", "dizel", "petrol", "fuel", "гориво", "нафта", "бензин", "дизел"]),
    ("4150", "Снабдување со вода", ["komunalec", "vodovod", "voda ", " voda", "water", "водовод", "вода", "канализ"]),
    ("4010", "Канцелариски материјали", ["kancelariski", "kancelar", "канцелар", "hartija", "paper", "toner", "тонер",
                                         "materijal", "repro"]),
    ("4011", "Материјал за чистење и одржување", ["^istko", "cistko", "chistko", "cleanin", "чистко", "чистење"]),
    ("4110", "Поштенски услуги", ["po[tenski", "postensk", "пошт", "makedonska po[ta", "ptt "]),
    ("4111", "Телефонски услуги", ["telefonski", "telekomunikac", "a1 mak", "one mak", "телефон", "telefon", "мобил", "mobil"]),
    ("4112", "Интернет услуги", ["internet", "wifi", "broadband", "fiber", "adsl", "интернет"]),
    ("4130", "Услуги за тековно и инвестиционо одржување", ["odr@uvawe", "odrzuvanje", "одржув", "поправк", "popravk", "tekovno",
                                                            "investiciono", "maintenance", "servis"]),
    ("4140", "Наемнини за деловни простории", ["naemnin", "kirija", "кирија", "закуп", "zakup", "renta", "najem", "leasing",
                                               "lizing", "наем"]),
    ("4450", "Премии за осигурување", ["osigur", "polisa", "triglav", "uniqa", "grawe", "insurance", "осигур", "полиса"]),
    ("4170", "Рекламирање и пропаганда", ["reklam", "marketing", "oglas", "реклам", "маркет", "огласув", "propaganda", "media"]),
    ("44905", "Нотарски услуги", ["notarski", "нотар", "notary"]),
    ("449051", "Адвокатски услуги", ["advokat", "правни", "pravni", "legal", "lawyer", "адвокат"]),
    ("44907", "ИТ услуги", ["software", "softvyer", "softver", "licenc", "лиценц", "cloud", "hosting", "saas", "erp",
                            "it service", "лиценза"]),
    ("44902", "Консултантски и советодавни услуги", ["konsalt", "konsultant", "sovetodav", "revizija", "reviz", "audit",
                                                     "консалт", "ревиз", "smetkovod", "сметководс"]),
    ("4460", "Банкарски услуги", ["bankarski", "banka", "bank ", "provizija", "камата", "kamata", "commission", "банка",
                                  "провизија"]),
    ("4109", "Транспортни услуги", ["prevoz", "transport", "dostava", "logistik", "freight", "cargo", "delivery", "kurirsk",
                                    "куриерск", "достава", "превоз", "такси", "taxi"]),
    ("44000", "Дневници за службени патувања", ["hotel", "avion", "airlin", "letov", "dnevnic", "travel", "хотел", "патувањ",
                                                "smestu", "сместув"]),
]

# --- Patterns: all read without regard to letter case -------------------------------------------------
# A leading look at the first letters of the words that follow changes no match, but spares trying every
# word at every place of a text. It lists both cases, as comparing without regard to case is what costs.


def _begins(letters: str) -> str:
    """Look ahead for one of some letters in any form that a pattern without regard to case takes for it."""
    wanted = {form for c in letters for form in (c.lower(), c.upper().lower())}
    forms = [c for c in map(chr, range(0x80, 0xD800)) if c.upper().lower() in wanted or c.lower() in wanted]
    plain = [c for c in map(chr, range(0x80)) if c.lower() in wanted]
    return "(?-i:(?=[" + "".join(plain + forms + (["İ"] if "i" in wanted else [])) + "]))"


# Horizontal blanks only.
H = r"[^\S\r\n]*"
H1 = r"[^\S\r\n]+"
# Shapes of an invoice number and of dates.
NUMBER = r"[A-Za-zА-Яа-яЃ-ЏЀ-ӿ0-9][A-Za-zА-Яа-яЃ-ЏЀ-ӿ0-9/\-\.]{1,30}"
DAY = r"\d{1,2}[./\-,]\d{1,2}[./\-,]\d{2,4}"

# Vendor labels on the line of the name, and labels that stand above it.
VENDOR_LABEL = (
    _begins("ДИНПФ") + r"(?:Добавувач|Издавач|Назив на фирма|Испорачувач|Продавач|Фактурант|Назив"
    r"|Подносители?\s+на\s+фактура)\s*[:\s]+(.+)"
)
VENDOR_LABEL_ABOVE = r"^(?:Подносители?\s+на\s+фактура|Потпишувач|Фактурант)\s*[:\-]?\s*$"

# Lines that are about the buyer, table heads, addresses, contacts, or start a field.
BUYER_LABEL = (
    r"^(?:До\s*:|Купувач\s*:|Испорачано\s+на\s*:|Bill\s+to\s*:|Наручувач\s*:|Клиент\s*:|Примач\s*:"
    r"|Комитент\s*:?)"
)
TABLE_HEAD = (
    r"(?:Количина|Кол\.\s*м|Единица|Ед\.\s*мерка|Назив на производ|Шифра|Тарифа"
    r"|Р\s*[\-\.]\s*бр|П\s*[\-\.]\s*бр|Попуст|Рабат|Даночна\s*основа|Вид на услуга"
    r"|Опис\s+на\s+услу|Услуга\s+/\s+Производ|Цена\s+без|Цена\s+со"
    r"|Број\s+на\s+фактура|Бр\.?\s+фактура|Датум\s+на\s+издавање)"
)
ADDRESS = r"\b(?:ул|ul|бул|bul|лок|lok)\.|\bбр\.\s*\d|\bbr\.\s*\d"
POST_BOX = r"\bп\.фах\b"
FIELD_START = r"^(?:Фактура|Invoice|Датум|Date|Бр\.|ДДВ|VAT|До\s*:|Купувач|Примач)\b"
YEAR = r"\b(19|20)\d{2}\b"
NUMERIC_ONLY = r"^[\d\s.,:/\-]+$"
CONTACT = (
    r"(?:\+\d{3}|\bтел\.?|\btel\.?|\bfax\.?|\bфакс\.?|\bмоб\.?|\bmob\.?"
    r"|\bT:\s*\+|\bF:\s*\+|@|www\.|\.com|\.mk|info@|e-mail)"
)

# Tax numbers (13 digits, with or without country letters).
VAT_PREFIXED = r"(?:МК|MK)\s*(\d{13})"
VAT_LABELLED = (
    r"(?:ЕДБ|Даночен број|EDB|Бр\. на регистрација на ДДВ|ДДВ бр|VAT ID)\s*[:\-]?\s*(?:МК|MK)?\s*(\d{13})"
)
VAT_NEARBY = r"(?:ЕДБ|Даночен|регистрација|EDB|VAT)(?s:.{0,60})"

# Invoice numbers by label, tried in this order.
NUMBER_PATTERNS = [
    _begins("ФFI") + rf"(?:Фактура|Faktura|Invoice)\s+(?:број|бр\.?|6р\.?)\s*[:\-]?\s*({NUMBER})",
    _begins("ФFI") + rf"(?:Фактура|Faktura|Invoice)\s*[№#]\s*({NUMBER})",
    _begins("ФFI") + rf"(?:Фактура|Faktura|Invoice)\s*[:\-]\s*({NUMBER})",
    rf"(?:Испратница|Ispratnica)\s*(?:број|бр\.?)?\s*[:\-]?\s*({NUMBER})",
    _begins("БB") + rf"(?:Број|Broj)\s+(?:на\s+)?(?:фактура|faktura)\s*[:\-]?\s*({NUMBER})",
    rf"(?:Бр\.?|бр\.?)\s+на\s+(?:фактура|faktura)\s*[:\-]?\s*({NUMBER})",
    r"\bINV[:\-]\s*([A-Za-z0-9][A-Za-z0-9/\-\.]{1,30})",
    r"\bИФФ\s*(\d{3,}/\d+)",
    _begins("ФFI") + r"(?:Фактура|Faktura|Invoice)\s+(\d[A-Za-z0-9/\-]{2,30})(?=[\s]|$)",
]
# Headings and looser labels of invoice numbers.
INVOICE_HEADING = _begins("ФFI") + r"(?:^|\b)(?:Фактура|Faktura|Invoice)\b"
NUMBER_AFTER_HEADING = rf"(?:број\s*[:\-]|Број\s+)({NUMBER})"
NUMBER_LABEL_ALONE = r"[бБ]рој\s*[:\-]\s*$"
NUMBER_ALONE = r"^(\d{2,}/\d+(?:-\d+)?)$"
NUMBER_LABEL = r"[Бб]рој\s+на\s+фактура"
NUMBER_STANDALONE = rf"(?<![A-Za-zА-Яа-яЃ-ЏЀ-ӿ])Број\s*[:\-]?\s*\-*\s*({NUMBER})"
NUMBER_LAST_RESORT = r"(?:бр|Бр)\.?\s*(\d+\s*/\s*\d+(?:\s*/\s*\d+)?|\d+\s*[\-]\s*\d+)"
NUMBER_OF_YEAR = r"\b(\d{2,5}/20\d{2})\b"
NUMBER_LIKE_VAT = r"^(?:МК|MK|Mk)[0-9OoОо]{5,}"
NUMBER_LIKE_DATE = r"^\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}$"

# Labels of due dates and invoice dates.
DUE_DATE = (
    _begins("ДРВDП") + r"(?:Доспева на|Датум на доспевање|Датум на валута|Рок за пла[кќй]ање|Рок на пла[кќй]ање"
    rf"|Валута|Due\s*date|Платливо до|Плаќање до)\s*[:\-]?\s*({DAY})г?"
)
DUE_DATE_UNTIL = (
    r"(?:Рок за пла[кќй]ање|Рок на пла[кќй]ање)[^.\n]{0,60}\bдо\s+(\d{1,2}[./\-]\w+[./\-]\d{2,4})"
)
DATE_PATTERNS = [
    rf"Датум на издавање\s*[:\-]?\s*({DAY})г?",
    rf"Датум на фактура\s*[:\-]?\s*({DAY})г?",
    rf"Датум на промет\s*[:\-]?\s*({DAY})г?",
]
DATE_BELOW_ISSUE_LABEL = rf"Датум{H1}на{H1}издавање{H}[:\-]?{H}\n{H}({DAY})"
DATE_BELOW_LABEL = rf"\bДатум{H}[:\-]?{H}\n{H}({DAY})"
DATE_GENERIC = _begins("ДD") + rf"(?:Датум|Date|Datum)\s*[:\-]?\s*({DAY})г?"
DATE_STANDALONE = r"\b(\d{1,2}[./\-]\d{1,2}[./\-]\d{4})г?(?=[\s,;:.\)]|$)"

# Labels of totals, net amounts and tax.
TOTAL_LABEL = (
    _begins("ВBЗЦ") + r"(?:[ВB][КK][Уy][Пn][НH][ОO]\s+[СC][ЕE]|Вкупно за пла[кќй]ање|Вкупно за наплата\s+денари"
    r"|Вкупно за наплата|Вкупно со ДДВ|Цена со ДДВ|За наплата\s+денари|За наплата|За пла[кќй]ање"
    r"|вкупно за платање|Вкупен износ за пла[кќй]ање|Вкупен износ)"
)
TOTAL_INLINE = TOTAL_LABEL + H + r"[:\-]?" + H + r"(?:MKD|MKД|ден\.?)?" + H + r"([\d.,]+)"
TOTAL_GENERIC = _begins("ВUT") + r"(?:Вкуп[нм]о?|Ukupno|Total)" + H + r"[:\-]?" + H + r"([\d.,]+)"
IN_WORDS = r"[CС][oо]?\s+зборови\b"
PAYMENT_TERM = r"\bРок\b.{0,20}\bпла[кќй]ање\b|\bРок\s+до\b|\bПлаќање\s+до\b"
NET_LABEL = (
    _begins("ОНБВИПOS") + r"(?:Основица|Нето износ|без ДДВ|Вредност без ДДВ|Износ без ДДВ|Вкупно без ДДВ"
    r"|Основа за ДДВ|Продажен износ без ДДВ)"
)
NET_INLINE = NET_LABEL[:-1] + r"|osnova|Subtotal)" + H + r"[:\-]?" + H + r"([\d.,]+)"
TAX_RATE_PATTERNS = [
    rf"ДДВ{H}(\d{{1,2}}){H}%", rf"(\d{{1,2}}){H}%{H}ДДВ", rf"DDV{H}(\d{{1,2}}){H}%", rf"VAT{H}(\d{{1,2}}){H}%",
]
_TAX_AMOUNT = r"((?:\d+[.,])+\d+|\d{3,})"
TAX_AMOUNT_PATTERNS = [
    rf"ДДВ\+{H}([\d.,]+)",
    rf"ДДВ{H}(?:\d{{1,2}}{H}%{H})?[+\-]?{H}{_TAX_AMOUNT}",
    rf"DDV{H}(?:\d{{1,2}}{H}%{H})?[+\-]?{H}{_TAX_AMOUNT}",
    rf"VAT{H}(?:\d{{1,2}}{H}%{H})?[+\-]?{H}{_TAX_AMOUNT}",
    rf"Данок\b[^:\n]{{0,35}}[:\-]\s*{_TAX_AMOUNT}",
]
TAX_LABEL_ALONE = r"^(?:ДДВ[\+\-]?|DDV[\+\-]?|VAT[\+\-]?)\s*$"
AMOUNT_AT_END = r"([\d.,]+)\s*$"
AMOUNT_AT_START = r"^([\d.,]+)"

# How the item table, the totals and the footer begin.
FIRST_ROW = r"^\s*1(?:\s*[.)]\s*\S|\s+\S)"
SECOND_ROW = r"^\s*2\s*[.)\s]"
COMMA_AMOUNT = r"\d[\d.]*,\d{1,2}"
TOTALS_START = r"^\s*(?:вкуп[нм]|основиц|даночна\s*основа|д[дц]в|за\s+наплата|вкупен\s+износ)"
FOOTER_START = (
    r"трансакциска\s+сметка|банка\s+сметка|swift\s*:|bic\s*:|потпис|печат|благодариме|директор"
)

# Words, in lower case, one of which a text holds wherever the pattern of that name matches.
INVOICE_WORDS = ("фактура", "faktura", "invoice")
NUMBER_WORDS = [
    INVOICE_WORDS, INVOICE_WORDS, INVOICE_WORDS, ("испратница", "ispratnica"), ("број", "broj"), ("фактура", "faktura"),
    ("inv:", "inv-"), ("ифф",), INVOICE_WORDS,
]
VENDOR_WORDS = ("добавувач", "издавач", "назив", "испорачувач", "продавач", "фактурант", "подносител")
VENDOR_ABOVE_WORDS = ("подносител", "потпишувач", "фактурант")
VAT_WORDS = ("едб", "даночен", "edb", "vat", "регистрација", "ддв бр")
DUE_WORDS = ("доспева", "валута", "рок ", "due", "платливо", "плаќање до")
DATE_WORDS = [("датум на издавање",), ("датум на фактура",), ("датум на промет",)]
# The look-alikes of the first label are spelled out by its first three letters.
TOTAL_WORDS = ("вку", "за наплата", "за пла", "цена со ддв", "вкy", "вkу", "вky", "bку", "bкy", "bkу", "bky")
NET_WORDS = ("основица", "без ддв", "нето износ", "основа за ддв")
TAX_RATE_WORDS = ["ддв", "ддв", "ddv", "vat"]
TAX_AMOUNT_WORDS = ["ддв+", "ддв", "ddv", "vat", "данок"]

# --- Generated template patterns and keyword analysis -------------------------------------------------

# What follows the anchor text in a generated pattern, by field.
_SEPARATOR = r"\s*[:\-]?\s*"
_DAY_CAPTURE = r"(\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4})"
GENERATED_SUFFIX = {
    "invoice_number": _SEPARATOR + f"({NUMBER})",
    "total": _SEPARATOR + r"(?:MKD|MKД|ден\.?)?\s*([\d.,]+)",
    "subtotal": _SEPARATOR + r"([\d.,]+)",
    "invoice_date": _SEPARATOR + _DAY_CAPTURE,
    "due_date": _SEPARATOR + _DAY_CAPTURE,
}
# Value kinds behind a keyword: kind, priority, shape of the token, capture group.
KEYWORD_KINDS = [
    ("vat_id", 5, r"^(?:MK|МК)\d{13}$", r"((?:MK|МК)\d{13})"),
    ("date", 4, r"^\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}$", _DAY_CAPTURE),
    ("invoice_number", 3, r"\d[/\-]\d", r"([A-Za-z0-9\/\-\.]{1,30})"),
    ("amount", 2, r"^\d[\d.,]*$", r"([\d\.,]+)"),
    ("text", 1, r"", r"(.+)"),
]
TEMPLATE_DEFAULT_FIELDS = ["vendor_name", "komitent_name", "komitent_sifra"]

# --- Export layouts ----------------------------------------------------------------------------------

# Columns of the ledger import file, in order.
LEDGER_COLUMNS = [
    "KONTO", "SODRZINA", "SIFRA KOMITENT", "IZVOD BR", "DEN DOLZI", "DEN POBARUVA", "DEV DOLZI",
    "DEV POBARUVA", "KURS", "DATUM VALUTA", "DATUM DOKUMENT", "ZABELESKA", "BROJ DOKUMENT",
    "DATUM KNIZENJE", "STATUS POC", "OE",
]
# Columns of the line-level import file, in order.
ERP_COLUMNS = [
    "Supplier Name", "VAT ID", "Invoice Ref", "Invoice Date", "Due Date", "Currency", "Net Amount",
    "VAT Rate (%)", "VAT Amount", "Gross Amount", "Payment Reference", "_Validation Flags",
]
# Accepted file types.
TEXT_LAYER_SUFFIXES = [".pdf"]
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".tiff", ".bmp"]
