"""Published data contract.

Everything in this module is a fixed value: file columns, status names, alias
entries, patterns and messages that readers and writers of the spending files
agree on.  There is no logic here.
"""

# --- fixed values: row status -------------------------------------------------
STATUS_OK = "ok"
STATUS_ADJUSTMENT = "ajuste"
STATUS_DUPLICATE = "duplicado"
STATUS_AMOUNT_IN_TEXT = "monto_en_texto"
STATUS_NOTE = "nota"
STATUS_NO_CATEGORY = "sin_categoria"
STATUS_NO_AMOUNT = "sin_monto"
ROW_STATUSES = [
    "ajuste",
    "duplicado",
    "monto_en_texto",
    "nota",
    "ok",
    "sin_categoria",
    "sin_monto",
]

# --- fixed values: run status ---------------------------------------------------
RUN_STATUSES = ["ok", "error", "partial"]

# --- fixed values: source and dataset names ---------------------------------------
SOURCE_NAME = "senado"
SOURCE_TITLE = "Senado de Chile"
ENDPOINT_NAME = "gastos-operacionales-senadores"
DATASET_NAME = "senado_gastos_operacionales"
EXPENSE_FILE_PREFIX = "senado_gastos_operacionales_"
ENTITY_FILE_PREFIX = "senado_gastos_operacionales_parlamentarios_"
PUBLISH_PREFIX = "senado/gastos_operacionales"
PUBLICATION_FROM = "2021-01"
PAGE_SIZE = 500

# --- fixed values: file columns ------------------------------------------------------
AVAILABLE_PERIOD_COLUMNS = [
    "fuente",
    "dataset",
    "source_id",
    "ano",
    "mes",
    "periodo",
    "endpoint",
    "url",
    "createdAt",
    "updatedAt",
    "selected",
    "source_url",
    "fecha_captura_utc",
    "raw_body_sha256",
    "raw_file",
]

ENTITY_COLUMNS = [
    "fuente",
    "dataset",
    "ano",
    "mes",
    "periodo",
    "unidad_ejecutora",
    "nombre",
    "appaterno",
    "apmaterno",
    "nombre_completo",
    "source_url",
    "fecha_captura_utc",
    "raw_body_sha256",
    "raw_file",
    "api_status",
    "api_results",
]

EXPENSE_COLUMNS = [
    "fuente",
    "dataset",
    "source_id",
    "ano",
    "mes",
    "periodo",
    "unidad_ejecutora",
    "nombre",
    "appaterno",
    "apmaterno",
    "nombre_completo",
    "gastos_operacionales",
    "monto",
    "createdAt",
    "updatedAt",
    "publishedAt",
    "source_url",
    "fecha_captura_utc",
    "raw_body_sha256",
    "raw_file",
    "api_status",
    "api_results",
    "api_page",
    "api_page_size",
    "api_page_count",
    "api_total",
]

CLEAN_COLUMNS = [
    "source_id",
    "row_number",
    "row_status",
    "include_in_ranking",
    "exclusion_reason",
    "fuente",
    "dataset",
    "ano",
    "mes",
    "periodo",
    "parlamentario_id",
    "parlamentario_nombre",
    "parlamentario_id_source",
    "unidad_ejecutora",
    "nombre_completo_raw",
    "categoria_id",
    "categoria_nombre",
    "categoria_key",
    "categoria_raw",
    "monto",
    "monto_raw",
    "source_url",
    "raw_file",
    "raw_body_sha256",
    "fecha_captura_utc",
]

RANKING_COLUMNS = [
    "periodo",
    "ano",
    "mes",
    "categoria_id",
    "categoria_nombre",
    "parlamentario_id",
    "parlamentario_nombre",
    "rank",
    "total_monto",
    "registros",
    "total_ajustes",
    "registros_ajuste",
    "registros_sin_monto",
    "registros_excluidos",
]

CATEGORY_COLUMNS = [
    "categoria_id",
    "categoria_nombre",
    "categoria_key",
    "rows",
    "included_rows",
    "excluded_rows",
    "total_monto",
    "raw_variant_count",
]

SPELLING_COLUMNS = [
    "categoria_id",
    "position",
    "categoria_raw",
    "rows",
    "rendered",
]

PROBLEM_EXAMPLE_COLUMNS = [
    "source_id",
    "periodo",
    "parlamentario_nombre",
    "categoria_raw",
    "monto_raw",
    "raw_file",
]

# --- fixed values: category aliases, key -> (id, name) ----------------------------------
CATEGORY_ALIASES = {
    "ACTIVIDADES REGIONALES": ("actividades_regionales", "Actividades regionales"),
    "ARRIENDO DE OFICINAS": ("arriendo_oficinas", "Arriendo de oficinas"),
    "ARRIENDO OFICINAS": ("arriendo_oficinas", "Arriendo de oficinas"),
    "COMPRA Y MANTENCION DOMINIO NIC": (
        "compra_mantencion_dominio_nic", "Compra y mantencion dominio NIC"),
    "COMPRA Y MANTENCION DE DOMINIO NIC": (
        "compra_mantencion_dominio_nic", "Compra y mantencion dominio NIC"),
    "DESC. POR PERSONAL DE APOYO": (
        "descuento_personal_apoyo", "Descuento por personal de apoyo"),
    "DESC.PERSONAL DE APOYO": (
        "descuento_personal_apoyo", "Descuento por personal de apoyo"),
    "DESC.POR PERSONAL APOYO": (
        "descuento_personal_apoyo", "Descuento por personal de apoyo"),
    "DESC.POR PERSONAL DE APOYO": (
        "descuento_personal_apoyo", "Descuento por personal de apoyo"),
    "DIFUSION": ("difusion", "Difusion"),
    "DISENO Y DESARROLLO PAG.WEB": (
        "diseno_desarrollo_pagina_web", "Diseno y desarrollo pagina web"),
    "DISENO Y DESARROLLO PAGINA WEB": (
        "diseno_desarrollo_pagina_web", "Diseno y desarrollo pagina web"),
    "MATERIALES DE OFICINA": ("materiales_oficina", "Materiales de oficina"),
    "OFICINAS PARLAMENTARIAS": ("oficinas_parlamentarias", "Oficinas parlamentarias"),
    "SERVICIO DE NUBE O CLOUD": ("servicio_nube_cloud", "Servicio de nube o cloud"),
    "SERVICIO NUBE O CLOUD": ("servicio_nube_cloud", "Servicio de nube o cloud"),
    "SERVICIOS MENORES": ("servicios_menores", "Servicios menores"),
    "TELEFONIA CELULAR": ("telefonia_celular", "Telefonia celular"),
    "TELEFONIA FIJA": ("telefonia_fija", "Telefonia fija"),
    "TRASLACION": ("traslacion", "Traslacion"),
}
NO_CATEGORY = ("sin_categoria", "Sin categoria")
NO_SLUG = "sin_valor"

# --- fixed values: category spellings and name particles -------------------------------------
CATEGORY_SPELLINGS = [
    ("PAG.WEB", "PAGINA WEB"),
    ("PAG. WEB", "PAGINA WEB"),
    ("PAGINA WEB.", "PAGINA WEB"),
]
CATEGORY_SUFFIX = " SENADORES"
NOTE_PREFIX = "NOTA"
NAME_PARTICLES = [" De ", " Del ", " La ", " Las ", " Los ", " Y "]

# --- fixed values: identity prefixes ------------------------------------------------------------
UNIT_ID_PREFIX = "senado_unidad_"
NAME_ID_PREFIX = "nombre_"
ID_FROM_UNIT = "unidad_ejecutora"
ID_FROM_NAME = "nombre_completo"

# --- fixed values: patterns (Java regex) -----------------------------------------------------------
PERIOD_PATTERN = r"^[0-9]{4}-(0[1-9]|1[0-2])\z"
SHA256_PATTERN = r"^[0-9a-f]{64}\z"
MONEY_TEXT_PATTERN = r"^-?\s*\$\s*[\p{Nd}.\s-]+\z"
AMOUNT_PATTERN = r"^-?\p{Nd}+\z"
MANIFEST_KEY_PATTERN = (
    r"^senado/gastos_operacionales/runs/[^/]+/pipeline_manifest[.]json\z")
MANIFEST_URL_PATTERN = (
    r"^https://[^\s]+/senado/gastos_operacionales/runs/[^/]+/pipeline_manifest[.]json\z")
TRUE_WORDS = ["true", "1", "yes", "si"]

# --- fixed values: gate and warning messages -----------------------------------------------------------
GATE_NO_SOURCE = "No hay filas fuente."
GATE_CLEAN_MISMATCH = "Filas clean (%d) no coinciden con filas fuente (%d)."
GATE_NO_INCLUDED = "No hay filas incluidas en ranking."
GATE_NO_RANKING = "No hay filas de ranking."
GATE_NO_CATEGORIES = "No hay categorias normalizadas."
GATE_NO_PERIODS = "No hay periodos detectados."
GATE_MISSING_PERIODS = "Hay periodos faltantes en el rango publico desde %s: %s."
GATE_MORE_PERIODS = "%s (+%d mas)"
GATE_DUPLICATES = "Hay %d filas duplicadas por source_id."
GATE_CONFLICTS = "Hay %d grupos source_id duplicados con contenido distinto."
GATE_NO_OK = "No hay filas con row_status ok."
GATE_BAD_PERIOD = "Periodo invalido '%s'. Usa YYYY-MM."
GATE_BAD_MONTH = "Mes invalido en periodo '%s'. Usa 01-12."
WARN_DUPLICATES = (
    "El CSV fuente contiene source_id duplicados. Re-ejecuta el scraper actualizado para "
    "recuperar paginas sin solapamiento antes de publicar rankings finales.")
WARN_CONFLICTS = "Hay source_id duplicados con contenido distinto; revisar fuente cruda."
WARN_MISSING = "Hay periodos faltantes dentro del rango disponible."

# --- fixed values: serving sort keys -> summary column ------------------------------------------------------
SORT_KEYS = {
    "promedio_mensual": "promedio_mensual",
    "total_monto": "total_monto",
    "registros": "registros",
    "meses_con_datos": "meses_con_datos",
    "nombre": "parlamentario_nombre",
}
NAME_COLLATION = "es"
