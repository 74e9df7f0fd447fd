"""Word lists, patterns, thresholds and messages that decide results.

Everything here is data that must keep exactly these values for the results to be right. Nothing in
this module computes anything.
"""

# --- urls -------------------------------------------------------------------------------------
TRACKING_PARAMETERS = ["fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source"]
TRACKING_PREFIX = "utm_"
LOCAL_HOSTS = ["localhost", "localhost.localdomain"]
LOCAL_SUFFIXES = [".local", ".internal"]
PUBLIC_ADMIN_HOSTS = r"(\.gob\.es|\.madrid\.org|(^|\.)boe\.es|(^|\.)bocm\.es|(^|\.)contrataciondelestado\.es)$"
LINK_IRRELEVANT_TERMS = [
    "login", "logout", "carrito", "cart", "cookies", "privacidad", "privacy", "legal", "calendar", "wp-admin",
]
LINK_RELEVANT_TERMS = [
    "promocion", "obra-nueva", "obra_nueva", "residencial", "viviendas", "chalets", "adosados", "pareados",
    "unifamiliares", "proyectos", "proximamente", "nueva-fase", "cooperativa",
]
SITEMAP_RELEVANT_TERMS = [
    "promocion", "obra-nueva", "obra_nueva", "residencial", "viviendas", "chalets", "adosados", "pareados",
    "unifamiliares", "proyectos", "cooperativa",
]
CALENDAR_LINK_FOLDER = "/CM_Boletin_BOCM/"
NOTICE_LINK_MARK = "Tablon.do?action=verAnuncio&id="

# --- text -------------------------------------------------------------------------------------
COMPANY_SUFFIXES = [" s l", " sl", " s a", " sa", " sociedad limitada", " sociedad anonima"]
EVIDENCE_LENGTH = 280
MIN_ALIAS_LENGTH = 7
MIN_DUPLICATE_TITLE_LENGTH = 8
THIN_PAGE_LENGTH = 220

# --- enums (name order is the ordinal) ----------------------------------------------------------
LOCATION_PRECISION = ["unknown", "municipalityCentroid", "locality", "developmentArea", "street", "exactCoordinates"]
OPPORTUNITY_KIND = [
    "landDisposal", "surfaceRight", "planning", "urbanizationWorks", "buildingPermit", "residentialDevelopment", "other",
]
CENTRAL_SOURCE_KINDS = ["regionalGazette", "stateGazette", "publicProcurement", "publicLandPortal"]
DIRECT_SOURCE_KIND = "municipalNoticeBoard"
COMMERCIAL_SOURCE_KIND = "officialCommercialWebsite"
WEB_SEARCH_KIND = "webSearch"
PENDING_STATUSES = ["new", "monitoring"]
CLOSED_STATUSES = ["rejected", "stale"]

# --- change tracking ----------------------------------------------------------------------------
TRACKED_FIELDS = {
    "priceFrom": "price_from", "priceTo": "price_to", "commercialStatus": "commercial_status",
    "constructionStatus": "construction_status", "availableUnits": "available_units",
    "deliveryDateText": "delivery_date_text", "builtAreaMinSqm": "built_area_min_sqm",
    "builtAreaMaxSqm": "built_area_max_sqm", "plotAreaMinSqm": "plot_area_min_sqm",
    "plotAreaMaxSqm": "plot_area_max_sqm", "active": "active",
}
DEACTIVATE_AFTER_MISSES = 3
STALE_AFTER_HOURS = 96
PUBLIC_CHANGE_LIMIT = 5000
QUALITY_ISSUE_LIMIT = 100
CHECK_DUE_HOURS = 36

# --- source confidence ----------------------------------------------------------------------------
SOURCE_KIND_BASE = {
    "officialPromoter": ("0.82", "Promotora oficial configurada."),
    "officialMicrosite": ("0.80", "Micrositio oficial configurado."),
    "publicAuthority": ("0.78", "Autoridad pública configurada."),
    "cooperativeManager": ("0.72", "Gestora de cooperativa configurada."),
    "exclusiveMarketer": ("0.68", "Comercializadora exclusiva configurada."),
    "builder": ("0.68", "Constructora configurada."),
}
SOURCE_KIND_OTHER = ("0.45", "Tipo de fuente no verificado.")
CONFIDENCE_SIGNALS = {
    "brochure": ("0.05", "Existe un dossier comercial enlazado."),
    "developer-identified": ("0.04", "La promotora está identificada en el contenido."),
    "evidence-rich": ("0.04", "Hay cuatro o más evidencias estructuradas."),
    "configured-domain-match": ("0.05", "El dominio canónico coincide con una URL inicial configurada."),
}

# --- triage ---------------------------------------------------------------------------------------
DIRECT_TERMS = [
    "obra nueva", "nueva promocion", "promocion", "residencial", "chalets", "viviendas unifamiliares", "cooperativa",
]
ADMINISTRATIVE_TERMS = [
    "licencia de obra", "plan parcial", "estudio de detalle", "suelo residencial", "parcela", "derecho de superficie",
    "urbanizacion",
]
GENERIC_ADMINISTRATIVE_TERMS = [
    "borme", "modelo de solicitud", "normas subsidiarias", "ordenanza fiscal", "publicaciones en el bocm",
    "solicitud de licencia", "texto refundido",
]
PRIORITY_RANK = {"high": 0, "medium": 1, "low": 2, "duplicate": 3}
AUDIT_REASON_RANK = {"singleChannelSignal": 0, "coverageGap": 1, "zeroSignalControl": 2, "crossChannelControl": 3}

# --- enrichment -------------------------------------------------------------------------------------
TEXT_FIELDS = {
    "address": "address", "postalCode": "postal_code", "developerName": "developer_name",
    "marketerName": "marketer_name", "cooperativeName": "cooperative_name",
    "deliveryDateText": "delivery_date_text", "buildingLicenceStatus": "building_licence_status",
}
INTEGER_FIELDS = {
    "totalUnits": "total_units", "availableUnits": "available_units", "bedroomsMin": "bedrooms_min",
    "bedroomsMax": "bedrooms_max", "bathroomsMin": "bathrooms_min", "bathroomsMax": "bathrooms_max",
    "garageSpacesMin": "garage_spaces_min", "garageSpacesMax": "garage_spaces_max",
}
DECIMAL_FIELDS = {
    "priceFrom": "price_from", "priceTo": "price_to", "usableAreaMinSqm": "usable_area_min_sqm",
    "usableAreaMaxSqm": "usable_area_max_sqm", "builtAreaMinSqm": "built_area_min_sqm",
    "builtAreaMaxSqm": "built_area_max_sqm", "plotAreaMinSqm": "plot_area_min_sqm",
    "plotAreaMaxSqm": "plot_area_max_sqm",
}
FILLABLE_FIELDS = [
    "address", "postalCode", "developerName", "marketerName", "cooperativeName", "totalUnits", "availableUnits",
    "priceFrom", "priceTo", "bedroomsMin", "bedroomsMax", "bathroomsMin", "bathroomsMax", "usableAreaMinSqm",
    "usableAreaMaxSqm", "builtAreaMinSqm", "builtAreaMaxSqm", "plotAreaMinSqm", "plotAreaMaxSqm", "garageSpacesMin",
    "garageSpacesMax", "deliveryDateText", "buildingLicenceStatus",
]
MIN_PROPOSAL_CONFIDENCE = "0.8"
MAX_VALUE_LENGTH = 200
ACCEPTED_MAX_AGE_DAYS = 30
PAGE_EVIDENCE_LENGTH = 3500
ENRICHMENT_NO_SOURCE = "No hay una fuente configurada para '%s'."
ENRICHMENT_NO_EVIDENCE = "No se obtuvo evidencia textual para '%s'."
CHUNK_LENGTH = 520
CHUNK_STEP = 440
CHUNK_SEPARATOR = " … "
EVIDENCE_KEYWORDS = {
    ("priceFrom", "priceTo"): ["precio", "desde", "hasta", "euros", "€"],
    ("bedroomsMin", "bedroomsMax"): ["dormitorio", "habitación", "habitacion"],
    ("bathroomsMin", "bathroomsMax"): ["baño", "bano", "aseo"],
    ("usableAreaMinSqm", "usableAreaMaxSqm"): ["útiles", "utiles", "superficie", "m²", "m2"],
    ("builtAreaMinSqm", "builtAreaMaxSqm"): ["construidos", "construida", "superficie", "m²", "m2"],
    ("plotAreaMinSqm", "plotAreaMaxSqm"): ["parcela", "jardín", "jardin", "m²", "m2"],
    ("developerName", "marketerName", "cooperativeName"): [
        "promotora", "promueve", "comercializa", "cooperativa", "developer"],
    ("totalUnits", "availableUnits"): ["viviendas", "unidades", "disponibles"],
    ("garageSpacesMin", "garageSpacesMax"): ["garaje", "aparcamiento", "plaza"],
    ("deliveryDateText",): ["entrega", "finalización", "finalizacion", "llaves"],
    ("buildingLicenceStatus",): ["licencia", "concedida", "obtenida", "solicitada"],
    ("address", "postalCode"): ["dirección", "direccion", "calle", "avenida", "código postal"],
}
# model -> USD per million input, cached input and output tokens
MODEL_PRICES = {
    "gpt-5.6-luna": ("1", "0.1", "6"),
    "gpt-5.6-terra": ("2.5", "0.25", "15"),
    "gpt-5.6-sol": ("5", "0.5", "30"),
    "gpt-5.6": ("5", "0.5", "30"),
}
CACHE_WRITE_FACTOR = "1.25"
TOKEN_RESERVE = 256

# --- messages -----------------------------------------------------------------------------------------
WARN_DUPLICATE = "Posible duplicado: se conserva separado por falta de evidencia concluyente."
WARN_CENTROID = "Ubicación aproximada: se muestra el centroide municipal."
ERR_NAME = "La promoción no tiene nombre."
ERR_URL = "La promoción no tiene una URL de origen HTTP(S) válida."
ERR_PRICE = "Los precios no pueden ser negativos."
ERR_COORDINATES = "Las coordenadas están fuera de rango."
ERR_CENTROID = "Una ubicación por centroide debe incluir coordenadas."
ISSUE_EMPTY = "La fuente devolvió cero entradas en dos ejecuciones consecutivas tras contener datos."

# --- text patterns (Java dialect; groups are numbered) ---------------------------------------------------
FLAGS = "(?iuU)"
PAT_TERMS = r"\b(?:obra\s+nueva|promoci[oó]n|residencial|viviendas?|chalets?|adosados?|pareados?|unifamiliares?)\b"
PAT_PRICE = (
    r"(?:desde|precio(?:\s+desde)?|a\s+partir\s+de)?\s*(\d{1,3}(?:\.\d{3})+|\d{2,3}\s\d{3}|\d{5,7})"
    r"(?:,\d{1,2})?\s*(?:€|EUR|euros?)"
)
PAT_MONTHLY = r"\b(?:al\s+mes|mensual(?:es)?|/\s*mes)\b"
PAT_BUILT_AREA = (
    r"(?:(?:desde\s+)?(\d{2,4}(?:[.,]\d+)?)\s*m(?:²|2)\s*(?:hasta|a|y|-)\s*(?:los?\s+)?(\d{2,4}(?:[.,]\d+)?)\s*m(?:²|2)"
    r"(?:\s+\p{L}+){0,2}\s+construid[ao]s?"
    r"|(?:superficie\s+)?construid[ao]s?\D{0,35}(\d{2,4}(?:[.,]\d+)?)(?:\s*m(?:²|2))?"
    r"(?:\s*(?:hasta|a|y|-)\s*(\d{2,4}(?:[.,]\d+)?))?\s*m(?:²|2)"
    r"|(\d{2,4}(?:[.,]\d+)?)\s*(?:hasta|a|y|-)\s*(\d{2,4}(?:[.,]\d+)?)\s*m(?:²|2)(?:\s+\p{L}+){0,2}\s+construid[ao]s?"
    r"|(\d{2,4}(?:[.,]\d+)?)\s*m(?:²|2)(?:\s+\p{L}+){0,2}\s+construid[ao]s?"
    r"|(\d{2,4}(?:[.,]\d+)?)\s*m(?:²|2)(?=\s+\d{1,2}\s+(?:habitaciones?|dormitorios?))"
    r"|(?:metros?\s*(?:²|2)|superficie)\s*:?\s*(?:desde\s+)?(\d{2,4}(?:[.,]\d+)?)(?:\s*m(?:²|2))?\s*(?:hasta|a|y|-)\s*"
    r"(\d{2,4}(?:[.,]\d+)?)\s*m(?:²|2)(?:\s+\p{L}+){0,2}\s+construid[ao]s?)"
)
BUILT_AREA_GROUPS = ("$1$3$5$7$8$9", "$2$4$6$10")
PAT_PLOT_AREA = (
    r"(?:parcelas?\D{0,35}|parcelas?\s+privadas?\s*:\s*terrenos?\s+exclusivos?\s+desde\s+)"
    r"((?:\d{2,5}(?:[.,]\d+)?|\d{1,2}(?:[.\s]\d{3})+))(?:\s*m(?:²|2))?"
    r"(?:\s*(?:hasta|a|y|-)\s*((?:\d{2,5}(?:[.,]\d+)?|\d{1,2}(?:[.\s]\d{3})+)))?\s*m(?:²|2)"
)
PAT_PLOT_VALUE = r"(\d{2,5}(?:[.,]\d+)?)\s+metros?\s+de\s+parcela\b"
PAT_BEDROOMS = r"(\d{1,2})(?:\s*(?:a|o|y|-)\s*(\d{1,2}))?\s+(?:dormitorios?|habitaciones?)"
PAT_BATHROOMS = r"(\d{1,2})(?:\s*(?:a|-)\s*(\d{1,2}))?\s+ba[nñ]os?"
PAT_GARAGE = r"(\d{1,2})(?:\s*(?:a|o|y|-)\s*(\d{1,2}))?\s+plazas?\s+de\s+(?:aparcamiento|garaje)\b"
PAT_INDEPENDENT = (
    r"\b(?:chalet|vivienda)s?(?:\s+unifamiliares?)?\s+(?:(?:adosad[oa]s?|paread[oa]s?)[,\sye]*){0,2}"
    r"(?:independientes?|individual(?:es)?)\b"
)
PAT_SEMI_DETACHED = r"\bparead[oa]s?\b"
PAT_TOWNHOUSE = r"\badosad[oa]s?\b"
PAT_NOT_TOWNHOUSE = r"\bno\s+(?:son\s+)?adosad[oa]s?\b"
PAT_PRIVATE_POOL = r"\bpiscina\s+privada\b"
PAT_COMMUNITY_POOL = (
    r"\b(?:piscina\s+(?:comunitaria|com[uú]n)|(?:urbanizaci[oó]n|parcelas?\s+comunitarias?|zonas?\s+com(?:[uú]n|unes))"
    r"\D{0,40}piscina)\b"
)
PAT_SOLD_OUT = r"\b(?:agotad[oa]|vendid[oa]\s+al\s+100\s*%)\b"
PAT_LAST_UNITS = r"\b(?:[uú]ltimas?\s+(?:viviendas?|unidades?)|[uú]ltima\s+(?:villa|chalet))\b"
PAT_UPCOMING = r"\b(?:pr[oó]ximamente|pr[oó]xima\s+fase)\b"
PAT_ON_SALE = r"\b(?:en\s+venta|a\s+la\s+venta|comercializaci[oó]n)\b"
PAT_PRE_SALES = r"precomercializaci[oó]n"
PAT_COMPLETED = r"\b(?:obra\s+finalizada|llave\s+en\s+mano)\b"
PAT_UNDER_CONSTRUCTION = r"\b(?:en\s+construcci[oó]n|obras?\s+iniciadas?|obra\s+en\s+ejecuci[oó]n)\b"
PAT_LICENSED = r"\blicencia\s+(?:concedida|otorgada|obtenida)\b"
PAT_LICENCE_REQUESTED = r"\blicencia\s+de\s+obra\s+solicitada\b"
PAT_DELIVERY = (
    r"((?:entrega|finalizaci[oó]n)(?:\s+prevista)?\D{0,20}(?:([1-4])(?:er|º|o)?\s*(?:trimestre|T)|Q[1-4])?\s*(20\d{2}))"
)
PAT_UNITS = r"(\d{1,4})\s+(?:(?:nuevas?|exclusivas?)\s+)?(?:viviendas?|chalets?)\b(?!\s+disponibles?)"
PAT_AVAILABLE = r"(?:(\d{1,3})\s+(?:viviendas?|unidades?)|(?:viviendas?|unidades?)\s*:?\s*(\d{1,3}))\s+disponibles?"
PAT_SINGLE_AVAILABLE = (
    r"\b(?:[uú]ltima|[uú]nica)\s+(?:(?:vivienda|villa|chalet)(?:\s+(?:disponible|a\s+la\s+venta))?|unidad)\b"
)
PAT_DEVELOPER = (
    r"(?:promueve|promotora|desarrollado\s+por)\s*:?\s*([\p{L}\d .,&'-]{2,80}?)"
    r"(?=\s+(?:obras?|entrega|en\s+venta|promoci[oó]n)|$)"
)
PAT_BROCHURE_TITLE = r"((?:residencial|promoci[oó]n)\s+[\p{L}\d .&'-]{3,100}?)(?=\s*[:\r\n]|$)"
PAT_COMMERCIAL_EVIDENCE = (
    r"\b(?:agotad[oa]|[uú]ltimas?\s+unidades?|pr[oó]ximamente|precomercializaci[oó]n|en\s+venta|comercializaci[oó]n)\b"
)
PAT_CONSTRUCTION_EVIDENCE = (
    r"\b(?:obra\s+finalizada|llave\s+en\s+mano|en\s+construcci[oó]n|obras?\s+iniciadas?|obra\s+en\s+ejecuci[oó]n"
    r"|licencia\s+(?:concedida|otorgada)|licencia\s+de\s+obra\s+solicitada)\b"
)
#: Literals in lower case without which a pattern cannot match: of every list at least one.
PAT_NEEDS = {
    PAT_TERMS: [["obra", "promoci", "residencial", "vivienda", "chalet", "adosado", "pareado", "unifamiliar"]],
    PAT_PRICE: [["€", "eur"]], PAT_BUILT_AREA: [["m²", "m2"], ["construid", "habitacion", "dormitorio"]],
    PAT_PLOT_AREA: [["parcela"], ["m²", "m2"]], PAT_PLOT_VALUE: [["parcela"], ["metro"]],
    PAT_BEDROOMS: [["dormitorio", "habitacion"]], PAT_BATHROOMS: [["bano", "baño"]], PAT_GARAGE: [["plaza"], ["aparcamiento", "garaje"]],
    PAT_INDEPENDENT: [["chalet", "vivienda"], ["independiente", "individual"]], PAT_SEMI_DETACHED: [["paread"]],
    PAT_TOWNHOUSE: [["adosad"]], PAT_NOT_TOWNHOUSE: [["adosad"]], PAT_PRIVATE_POOL: [["piscina"], ["privada"]], PAT_COMMUNITY_POOL: [["piscina"]],
    PAT_SOLD_OUT: [["agotad", "vendid"]], PAT_LAST_UNITS: [["ltima"]], PAT_UPCOMING: [["xima"]], PAT_ON_SALE: [["venta", "comercializaci"]],
    PAT_PRE_SALES: [["precomercializaci"]], PAT_COMPLETED: [["finalizada", "llave"]],
    PAT_UNDER_CONSTRUCTION: [["construcci", "iniciada", "ejecuci"]], PAT_LICENSED: [["licencia"], ["concedida", "otorgada", "obtenida"]],
    PAT_LICENCE_REQUESTED: [["licencia"], ["solicitada"]], PAT_DELIVERY: [["entrega", "finalizaci"], ["20"]],
    PAT_UNITS: [["vivienda", "chalet"]], PAT_AVAILABLE: [["disponible"]], PAT_SINGLE_AVAILABLE: [["ltima", "nica"]],
    PAT_DEVELOPER: [["promueve", "promotora", "desarrollado"]], PAT_BROCHURE_TITLE: [["residencial", "promoci"]],
    PAT_COMMERCIAL_EVIDENCE: [["agotad", "ltima", "ximamente", "comercializaci", "venta"]],
    PAT_CONSTRUCTION_EVIDENCE: [["obra", "llave", "construcci", "licencia"]],
}
PRICE_RANGE = (50_000, 10_000_000)
BUILT_AREA_RANGE = (10, 5_000)
PLOT_AREA_RANGE = (20, 10_000)

# --- embedded structured data ---------------------------------------------------------------------------
LISTING_NODE_TYPES = ["product", "residence", "house", "apartment", "realestatelisting", "accommodation"]

# --- published table -----------------------------------------------------------------------------------
# exported column -> our column
CSV_COLUMNS = {
    "id": "id", "name": "name", "municipality": "municipality", "locality": "locality",
    "propertyTypes": "property_types", "commercialStatus": "commercial_status",
    "constructionStatus": "construction_status", "priceFrom": "price_from", "priceTo": "price_to",
    "bedroomsMin": "bedrooms_min", "bedroomsMax": "bedrooms_max", "builtAreaMinSqm": "built_area_min_sqm",
    "builtAreaMaxSqm": "built_area_max_sqm", "plotAreaMinSqm": "plot_area_min_sqm",
    "plotAreaMaxSqm": "plot_area_max_sqm", "developerName": "developer_name", "sourceKind": "source_kind",
    "sourceConfidence": "source_confidence", "latitude": "latitude", "longitude": "longitude",
    "locationPrecision": "location_precision", "active": "active", "lastSeenUtc": "last_seen_utc",
    "canonicalUrl": "canonical_url",
}
