"""Word lists, patterns and tables of the domain.

Everything in this module is a fixed value: results only agree if these are the same.  Patterns are in
the dialect that Java, RE2 and Python share, unless noted.
"""

# fmt: off
#: Markers of the rhetorical sections.
T1_PATTERNS = {
    "INTRO": r"\b(objetivo|objetivos|introducci[oó]n|problema\sde\sinvestigaci[oó]n|justificaci[oó]n|prop[oó]sito|el\spresente\strabajo|esta\sinvestigaci[oó]n|planteamiento)\b",
    "BACK": r"\b(antecedentes|estado\sdel\sarte|trabajos\sprevios|marco\ste[oó]rico|estudios\sprevios|literatura|seg[uú]n|et\sal|autores\scomo)\b",
    "METH": r"\b(metodolog[íi]a|m[eé]todo|procedimiento|dise[nñ]o|muestra|participantes|cuestionario|an[aá]lisis\sestad[íi]stico|tipo\sde\sestudio|muestreo)\b",
    "RES": r"\b(resultados|hallazgos|los\sresultados|se\sencontr[oó]|se\sobserv[oó]|estad[íi]sticamente|correlaci[oó]n|se\sobtuvieron|en\sla\stabla|valor\sde\sp)\b",
    "DISC": r"\b(discusi[oó]n|estos\sresultados\ssugieren|esto\simplica|estos\shallazgos|en\scontraste\scon|coincide\scon|difiere\sde|lo\scual\sindica)\b",
    "CONTR": r"\b(contribuci[oó]n|nuestro\senfoque|proponemos|presentamos|introducimos|nuestra\spropuesta|a\sdiferencia\sde\strabajos|se\spropone\sun\snuevo|supera\sal\sestado|la\saportaci[oó]n|aportaci[oó]n)\b",
    "LIM": r"\b(limitaci[oó]n|limitaciones|no\sfue\sposible|sesgo|tama[nñ]o\smuestral|muestra\speque[nñ]a|futuras\sinvestigaciones|trabajo\sfuturo|restricci[oó]n)\b",
    "CONC": r"\b(conclusi[oó]n|conclusiones|en\sconclusi[oó]n|para\sconcluir|se\sconcluye\sque|en\sresumen|finalmente|se\srecomienda)\b",
}
#: Sections in the order in which ties are settled.
T1_PRIORITY = [
    "CONTR",
    "INTRO",
    "CONC",
    "LIM",
    "METH",
    "BACK",
    "RES",
    "DISC",
]
#: Names of the sections.
T1_NAMES = {
    "INTRO": "Introducción",
    "BACK": "Antecedentes",
    "METH": "Metodología",
    "RES": "Resultados",
    "DISC": "Discusión",
    "CONTR": "Contribución",
    "LIM": "Limitaciones",
    "CONC": "Conclusión",
}
#: Their colours.
T1_COLORS = {
    "INTRO": "#2563EB",
    "BACK": "#7C3AED",
    "METH": "#84CC16",
    "RES": "#16A34A",
    "DISC": "#0F766E",
    "CONTR": "#DC2626",
    "LIM": "#C026D3",
    "CONC": "#D97706",
}
#: Fixed value: markers of a contribution.
T2_PATTERN = r"\b(proponemos|presentamos|introducimos|desarrollamos|contribuimos|aportamos|se\spropone|se\spresenta|se\sintroduce|se\sdesarrolla|se\sconstruye|se\screa|este\strabajo\sporta|nuestra\spropuesta|nuestro\sm[eé]todo|nuestro\senfoque|nuestra\sarquitectura|nuestro\smodelo|nuestra\ssoluci[oó]n|supera\sal\sestado\sdel\sarte|a\sdiferencia\sde\strabajos|la\sprincipal\saportaci[oó]n|la\sprincipal\scontribuci[oó]n|contribuci[oó]n|aportaci[oó]n|el\sobjetivo\sde\seste\strabajo\ses|ponemos\sa\sdisposici[oó]n|nuevo\sm[eé]todo|nuevo\senfoque|nueva\sarquitectura|nueva\smetodolog[íi]a)\b"
#: Markers of sections counted against a threshold.
SECTION_PATTERNS = {
    "INTRO": r"\b(objetivo\sgeneral|objetivo\sprincipal|el\sobjetivo\sde\s(?:este|esta)|problema\sde\sinvestigaci[oó]n|introducci[oó]n|justificaci[oó]n|prop[oó]sito\sprincipal|planteamiento\sdel\sproblema|el\spresente\strabajo\s(?:aborda|tiene\scomo|se\scentra)|la\sfinalidad\sde\s(?:este|esta)|hip[oó]tesis\sde\strabajo)\b",
    "BACK": r"\b(antecedentes|estado\sdel\sarte|trabajos\sprevios|marco\ste[oó]rico|estudios\sprevios|investigaciones\sprevias|revisi[oó]n\sbibliogr[aá]fica|literatura\scient[ií]fica|trabajo\srelacionado|et\sal\.|seg[uú]n\s[A-Z][a-z]+|estudios\santeriores|tradicionalmente)\b",
    "METH": r"\b(metodolog[íi]a|dise[ñn]o\smetodol[oó]gico|dise[ñn]o\sde\sinvestigaci[oó]n|materiales\sy\sm[eé]todos|material\sy\sm[eé]todo|poblaci[oó]n\sy\smuestra|tama[ñn]o\sde\s(?:la\s)?muestra|criterios\sde\sinclusi[oó]n|criterios\sde\sexclusi[oó]n|instrumentos\sde\srecolecci[oó]n|recolecci[oó]n\sde\sdatos|an[aá]lisis\sestad[íi]stico|procedimiento\sexperimental|enfoque\scuantitativo|enfoque\scualitativo|investigaci[oó]n\s(?:cualitativa|cuantitativa)|entrevistas\ssemiestructuradas|aplicaci[oó]n\sde\scuestionarios|variables\sdependientes|variables\sindependientes)\b",
    "RES": r"\b(resultados|hallazgos|los\sresultados\smuestran|los\sresultados\sindican|los\sresultados\sobtenidos|los\sdatos\smuestran|los\sanálisis\smuestran|el\sanálisis\sindica|el\sanálisis\sreveló|se\sencontró\sque|se\sobservó\sque|se\sidentificó|se\sdetectó|se\sevidenció|se\sregistró|se\sobtuvieron|se\spudo\sobservar|se\sapreció|arrojó|reveló|mostró|evidenció|como\sse\smuestra\sen|como\sse\sobserva\sen|como\sse\saprecia\sen|en\sla\sfigura|en\sel\sgráfico|en\sla\stabla|en\sel\scuadro|tal\scomo\sse\smuestra|véase\sla\sfigura|véase\sla\stabla|estadísticamente\ssignificativo|diferencia\ssignificativa|no\ssignificativo|correlación\spositiva|correlación\snegativa|valor\sde\sp|p\s[<>≤≥]\s0\.|intervalo\sde\sconfianza|desviación\sestándar|error\sestándar|media\sde|mediana\sde|coeficiente\sde|odds\sratio|razón\sde|frecuencia\srelativa|un\saumento\sde|una\sreducción\sde|una\sdisminución\sde|superior\sa|inferior\sa|mayor\sque|menor\sque|el\s\d+\s?%\sde|un\s\d+\s?%|aproximadamente\sel|los\sresultados\sobtuvieron|los\sparticipantes\sreportaron)\b",
    "DISC": r"\b(discusi[oó]n|interpretaci[oó]n\sde\slos\sresultados|an[aá]lisis\scr[ií]tico|en\sconcordancia\scon|coincide\scon|consistente\scon|similar\sa\slo\sreportado|en\sl[ií]nea\scon|est[aá]\sde\sacuerdo\scon|a\sdiferencia\sde|en\scontraste\scon|difiere\sde|contrario\sa|mientras\sque\sotros\sautores|comparado\scon\sel\sestudio\sde|estos\sresultados\ssugieren|estos\shallazgos|esto\simplica\sque|esto\sindica\sque|lo\santerior\ssugiere|apoya\sla\ship[oó]tesis|valida\snuestro\senfoque|corrobora\sque|permite\sinferir|se\sinterpreta\scomo|da\scuenta\sde|esto\sse\sdebe\sa|podr[ií]a\sexplicarse\spor|atribuible\sa|es\sposible\sque|podr[ií]a\sdeberse\sa|una\sposible\sexplicaci[oó]n|probablemente\sdebido\sa|factores\sque\sinfluyeron|a\sla\sluz\sde|bajo\sesta\sperspectiva|nos\slleva\sa\spensar|relevancia\spara|impacto\sen|consecuencia\sde|abre\snuevas\sperspectivas|demuestra\sla\simportancia\sde)\b",
    "LIM": r"\b(limitaci[oó]n|limitaciones|no\sfue\sposible|no\ses\sposible|sesgos\spotenciales|no\sse\spuede|sesgo|sesgado|sesgada|se\sdesconoce|imposibilidad|no\spermite|no\spermite\sgeneralizar|fuera\sdel\salcance|no\sse\spudo|no\sse\spretende|restricci[oó]n|restringe\sla|no\sgeneraliz|no\srepresenta|tama[ñn]o\sde\sla\smuestra|tama[ñn]o\smuestral|muestra\speque[ñn]a|futuras\sinvestigaciones|futuras\sl[íi]neas|l[íi]neas\sfuturas|investigaci[oó]n\sfutura|trabajo\sfuturo|queda\spendiente|falta\sde|carencia\sde|no\sse\sdispone|pese\sa\sno\scontar|sin\scontar\scon|no\sabarca|no\sincluye|no\scontempla|ciertas\slimitaciones|estas\slimitaciones|dificulta|dificultades\sy\slimitaciones|debe\sinterpretarse\scon\scautela|dise[ñn]o\stransversal\sno\spermite)\b",
    "CONC": r"\b(conclusiones|conclusi[oó]n|en\sconclusi[oó]n|a\smodo\sde\sconclusi[oó]n|para\sconcluir|como\sconclusi[oó]n|a\st[íi]tulo\sde\sconclusi[oó]n|se\sconcluye\sque|podemos\sconcluir|cabe\sconcluir|es\sposible\sconcluir|permite\sconcluir|lleva\sa\sconcluir|los\sresultados\spermiten\sconcluir|los\shallazgos\spermiten\sconcluir|en\sresumen|en\ss[íi]ntesis|en\sdefinitiva|en\s[uú]ltima\sinstancia|implicaciones\spr[aá]cticas|como\sreflexi[oó]n\sfinal|en\sconjunto[,\s]|tomados\sen\sconjunto|globalmente[,\s]|en\sglobal|en\st[ée]rminos\sgenerales[,\s]|este\sestudio\sha\sdemostrado|este\strabajo\sha\sdemostrado|esta\sinvestigaci[oó]n\sha\sconfirmado|este\sestudio\sconfirma|este\strabajo\saporta\sevidencia|se\sha\sdemostrado\sque|se\sha\scomprobado\sque|se\sha\sevidenciado\sque|los\sresultados\sobtenidos\sconfirman|se\srecomienda|se\ssugiere\sque|futuras\sinvestigaciones\sdeber[íi]a|pr[oó]ximas\sinvestigaciones|estudios\sfuturos\sdeber[íi]a|es\snecesario\scontinua|queda\spendiente\spara\sfuturas|finalmente[,\s])\b",
}
#: Least number of markers of a section.
SECTION_THRESHOLDS = {
    "DISC": 2,
    "CONC": 2,
    "INTRO": 3,
    "LIM": 2,
    "BACK": 3,
    "METH": 4,
    "RES": 4,
}
#: Explicit signs of a contribution, in lower-case text, with their labels.
EXPLICIT_PATTERNS = [
    (r"\b(?:este|esta|el\s+presente|la\s+presente|dicho|dicha)\s+(?:trabajo|art\w+culo|estudio|paper|documento|manuscrito|contribuci\w+|aportaci\w+|propuesta|investigaci\w+)\s+(?:propone|presenta|introduce|aporta|desarrolla|contribuye|describe|ofrece|plantea|diseña|implementa|establece|analiza)", "B01-demostrativo+verbo"),
    (r"\b(?:proponemos|presentamos|introducimos|desarrollamos|describimos|ofrecemos|diseñamos|implementamos|construimos|evaluamos|aportamos|contribuimos)\b", "B02-1PL"),
    (r"\bse\s+(?:propone|presenta|introduce|desarrolla|aporta|implementa|construye|establece|define|formula|plantea|concibe|elabora)\s+(?:un|una)\b", "B03-pasiva+objeto"),
    (r"\b(?:el\s+presente|el\s+actual)\s+(?:trabajo|artículo|estudio|documento)\s+(?:propone|presenta|introduce|aporta|desarrolla|contribuye|diseña|implementa|establece|ofrece|plantea|describe)", "B04-presente+verbo"),
    (r"\b(?:las?\s+)?(?:contribuciones?|aportaciones?)\s+(?:principales?|clave|centrales?|más\s+relevantes?)?\s*(?:de\s+este\s+(?:trabajo|artículo|estudio)|son)\b", "B05-nominal"),
    (r"\b(?:como|la)\s+(?:principal|mayor|primordial|fundamental)?\s*(?:contribuci\w+|aportaci\w+|aporte)\s*(?:de\s+este\s+\w+\s*)?(?:es|,)?\b", "B06-principal-aport"),
    (r"\b(?:nuestra?s?)\s+(?:propuesta?|enfoque|método|modelo|sistema|marco|arquitectura|algoritmo|herramienta|aproximaci\w+|estrategia|soluci\w+|pipeline|corpus|dataset)\b", "B07-posesivo+objeto"),
    (r"\b(?:supera(?:ndo)?|mejora(?:ndo)?)\s+(?:a\s+|al\s+)?(?:los?\s+)?(?:m\w+todos?|modelos?|enfoques?|sistemas?|baselines?|resultados?|algoritmos?)?\s*(?:del?\s+)?(?:estado\s+del\s+arte|anteriores?|existentes?|previos?)\b", "B08-supera-SOTA"),
    (r"\b(?:obtiene(?:n)?|logra(?:n)?|alcanza(?:n)?|consigue(?:n)?)\s+(?:mejores?|superiores?)\s+(?:resultados?|rendimiento|desempe\w+|precisi\w+|puntuaciones?)\b", "B09-mejores-resultados"),
    (r"\b(?:los?\s+)?(?:experimentos?|evaluaci\w+|resultados?|an\w+lisis)\s+(?:obtenidos?\s+)?(?:demuestran?|muestran?|confirman?|evidencian?|indican?)\s+que\b", "B10-experimentos-demuestran"),
    (r"\bpor\s+primera\s+vez\b", "B11-primera-vez"),
    (r"\bel\s+(?:objetivo|prop\w+sito|fin)\s+(?:principal|central|fundamental|primordial)?\s+(?:de\s+este\s+(?:trabajo|artículo|estudio)|del\s+(?:presente\s+)?(?:trabajo|artículo))\s+es\b", "B12-objetivo-principal"),
    (r"\b(?:ponemos\s+a\s+disposici\w+|publicamos?|liberamos?|compartimos?|hacemos?\s+disponibles?)\b", "B13-disposicion"),
    (r"\bse\s+(?:construye|crea|desarrolla|compila|recopila)\s+(?:un|una)\s+(?:corpus|dataset|conjunto\s+de\s+datos|recurso|banco\s+de\s+datos)\b", "B14-recurso"),
    (r"\b(?:de\s+(?:forma|manera)\s+(?:novedosa|innovadora|original|in\w+dita)|sin\s+precedentes\s+en)\b", "B15-novedad-locucion"),
    (r"\b(?:introducimos|presentamos)\s+(?:una?\s+)?(?:nueva?|novedosa?|original)?\s*(?:m\w+trica|marco|arquitectura|herramienta|metodolog\w+|enfoque|sistema|modelo|algoritmo)\b", "B16-introducimos"),
    (r"\ba\s+diferencia\s+de\s+(?:trabajos?|aproximaciones?|enfoques?|métodos?|estudios?)\s+(?:previos?|previas?|anteriores?|existentes?)", "B17-diferencia"),
    (r"\b(?:contribuimos?\s+con|aporta(?:mos?)?\s+(?:evidencia|informaci\w+|un\s+an\w+lisis|datos?|un\s+modelo|una\s+herramienta|resultados?))\b", "B18-contribuimos"),
    (r"\b(?:hallazgos?|resultados?|aportes?)\s+(?:principales?|clave|más\s+relevantes?)\s*(?:de\s+este\s+(?:trabajo|artículo|estudio))?\b", "B19-hallazgos"),
    (r"\b(?:la\s+propuesta|el\s+m\w+todo|el\s+enfoque|el\s+sistema|la\s+arquitectura|el\s+modelo)\s+(?:propuesto|propuesta|presentado|presentada|desarrollado|desarrollada)\b", "B20-propuesta"),
]
#: Implicit signs of a contribution (I02 needs look-around).
IMPLICIT_PATTERNS = [
    (r"\b(?:logramos?|alcanzamos?|obtuvimos?|conseguimos?|demostramos?|evidenciamos?|verificamos?)\b", "I01-logro-1PL"),
    (r"\bse\s+(?:logra|alcanza|obtiene|consigue|demuestra|verifica)\b(?=.{0,120}(?:mejor|mayor|superior|novedoso|novedosa|por\s+primera\s+vez|mas\s+preciso|sin\s+precedente|estado\s+del\s+arte|supera|mejora|incremento|reduccion|innovador|innovadora|propuesto|propuesta))(?!.{0,40}(?:\d+[,.]\d+\s*(?:kn|kpa|mpa|mm|cm|m\b|kg|n\b|%)|perfil|viga|pilar|losa|forjado|carga|coeficiente\s+de))", "I02-logro-pasiva"),
    (r"\b(?:supera(?:n)?|mejora(?:n)?)\s+(?:los?|las?|el|la|su|nuestro|significativamente|considerablemente|notablemente)\b|\bsupone\s+una\s+mejora\s+(?:significativa|considerable|de\s+)|\brendimiento\s+superior\b|\bmayor\s+precisi\w+\b|\bmejor\s+desempe\w+\b|\bresultados?\s+superiores?\b", "I03-superioridad"),
    (r"\b(?:resuelve(?:n)?|resolvemos?|soluciona(?:n)?|solucionamos?|aborda(?:n)?\s+el\s+(?:problema|desaf\w+o|reto|limitaci\w+)|supera(?:n)?\s+la\s+limitaci\w+)\b", "I04-resolucion"),
    (r"\b(?:nunca\s+antes|sin\s+precedentes?|in\w+dito|primer\s+(?:trabajo|estudio|sistema))\b", "I05-novedad"),
    (r"\b(?:esto\s+permite|lo\s+que\s+permite|lo\s+cual\s+posibilita|lo\s+que\s+facilita|con\s+implicaciones\s+para)\b", "I06-habilita"),
    (r"\b(?:en\s+contraste\s+con|frente\s+a\s+(?:los?\s+)?(?:m\w+todos?|enfoques?|trabajos?)\s+(?:previos?|previas?|anteriores?|existentes?))\b", "I07-contraste"),
    (r"\b(?:constituye\s+(?:un|una)\s+(?:avance|contribuci\w+|aporte)|representa\s+(?:un|una)\s+(?:avance|mejora|contribuci\w+|novedad))\b", "I08-avance"),
    (r"\b(?:reducci\w+|incremento|aumento|mejora)\s+(?:del?|de\s+un)\s+\d", "I09-mejora-metrica"),
    (r"\b(?:nuestro\s+(?:enfoque|m\w+todo|modelo|sistema|algoritmo)\s+(?:supera|mejora|aventaja|obtiene\s+mejores?\s+resultados?))\b", "I10-nuestro-supera"),
]
#: Parts of headings under which contributions are frequent.
HIGH_PRIOR_SECTIONS = [
    "conclus",
    "aportac",
    "contribuc",
    "resumen",
    "abstract",
    "síntesis",
    "discusi",
    "hallazgo",
    "objetivo",
]
#: Neutral wording for each sign.
NEUTRALIZATIONS = {
    "B01-demostrativo+verbo": "[TEXTO] analiza",
    "B02-1PL": "se describe",
    "B03-pasiva+objeto": "se utiliza un",
    "B04-presente+verbo": "el documento incluye",
    "B05-nominal": "los aspectos",
    "B06-principal-aport": "el tema central",
    "B07-posesivo+objeto": "el enfoque revisado",
    "B08-supera-SOTA": "se compara con trabajos anteriores",
    "B09-mejores-resultados": "obtiene resultados",
    "B10-experimentos-demuestran": "los datos analizados muestran que",
    "B11-primera-vez": "en el periodo estudiado",
    "B12-objetivo-principal": "el alcance del documento es",
    "B13-disposicion": "se describen los recursos",
    "B14-recurso": "se utiliza un",
    "B15-novedad-locucion": "de forma sistemática",
    "B16-introducimos": "se describe una",
    "B17-diferencia": "en relación con trabajos previos",
    "B18-contribuimos": "se presenta",
    "B19-hallazgos": "los aspectos revisados",
    "B20-propuesta": "el enfoque descrito",
    "I01-logro-1PL": "se observó",
    "I02-logro-pasiva": "se obtiene",
    "I03-superioridad": "se compara",
    "I07-contraste": "en relación con trabajos previos",
    "I08-avance": "representa un aspecto relevante",
    "I10-nuestro-supera": "el enfoque descrito muestra",
}
#: Phrases put before texts without a contribution.
INJECTION_PHRASES = [
    "Este trabajo propone un nuevo enfoque para el análisis de los datos presentados a continuación.",
    "Proponemos una metodología sistemática para abordar los aspectos descritos en este documento.",
    "La principal contribución de este estudio es el análisis detallado que se presenta a continuación.",
    "Se introduce un marco de referencia para la evaluación de los elementos descritos.",
    "Nuestra propuesta consiste en el análisis de los datos y su interpretación en el contexto.",
    "A diferencia de trabajos previos, en este documento se describe el siguiente procedimiento.",
    "El presente trabajo presenta los resultados del análisis llevado a cabo.",
    "Como principal aportación, se describe el siguiente conjunto de observaciones.",
    "Los resultados obtenidos demuestran que los elementos analizados siguen los patrones esperados.",
    "Se desarrolla un análisis sistemático de los datos presentados a continuación.",
    "Este estudio contribuye con la descripción detallada del proceso analizado.",
    "El objetivo principal de este documento es presentar los datos recopilados.",
    "Presentamos el siguiente análisis basado en los datos disponibles.",
    "Nuestra metodología permite analizar los datos de forma sistemática.",
    "Se construye una base de datos con los elementos identificados en el estudio.",
    "Los experimentos realizados muestran que los datos presentados son consistentes.",
    "A continuación se introduce el enfoque seguido para la descripción de los resultados.",
    "El presente estudio analiza los aspectos mencionados a continuación.",
    "Introducimos el siguiente procedimiento para el análisis de los elementos estudiados.",
    "Este trabajo aporta la descripción sistemática de los procesos observados.",
]
#: Answers of language models and the sections they name.
ANSWER_LABELS = {
    "INTRO": "INTRO",
    "BACK": "BACK",
    "METH": "METH",
    "RES": "RES",
    "DISC": "DISC",
    "LIM": "LIM",
    "CONC": "CONC",
    "CONTR": "CONTR",
    "INTRODUCCION": "INTRO",
    "INTRODUCCIÓN": "INTRO",
    "ANTECEDENTES": "BACK",
    "BACKGROUND": "BACK",
    "ESTADO DEL ARTE": "BACK",
    "METODOLOGIA": "METH",
    "METODOLOGÍA": "METH",
    "METODO": "METH",
    "MÉTODO": "METH",
    "RESULTADOS": "RES",
    "HALLAZGOS": "RES",
    "DISCUSION": "DISC",
    "DISCUSIÓN": "DISC",
    "LIMITACIONES": "LIM",
    "LIMITACION": "LIM",
    "CONCLUSION": "CONC",
    "CONCLUSIÓN": "CONC",
    "CONCLUSIONES": "CONC",
    "CONTRIBUCION": "CONTR",
    "CONTRIBUCIÓN": "CONTR",
    "CONTRIBUCIONES": "CONTR",
}
#: Words of which a formal paper has at least two in its first 2,000 characters.
ACADEMIC_ANCHORS = ["resumen", "abstract", "introducción", "bibliografía", "conclusiones", "universidad", "facultad", "doi:", "issn"]
#: Marks of a list of references.
BIBLIOGRAPHY_MARKS = ["et al.", "vol.", "pp.", "doi:", "journal", "press"]
#: Words masked in any case.
SOFT_MASK_KEYWORDS = [
    "introducción", "introduccion", "objetivos", "justificacion", "justificación", "antecedentes", "estado del arte", "metodología", "metodologia",
    "materiales y métodos", "resultados", "discusión", "discusion", "conclusiones", "trabajo futuro", "limitaciones", "recomendaciones",
]
#: Signs of the pages before the text of a thesis; the first and the eighth mind case.
FRONTMATTER_PATTERNS = [
    r"\bORCID\b", r"(?i)\bdedicatoria\b", r"(?i)\bagradecimiento[s]?\b", r"(?i)\bjurado[s]?\b", r"(?i)\basesor(a|es|as)?\b", r"(?i)\bamor\s+(incondicional|infinito)\b",
    r"(?i)\boptar\s+(al|por|el)\s+(el\s+)?(t[ií]tulo|grado)\b", r"\bDra?\.\s+[A-ZÁ-Ú][a-záéíóúñ]+", r"(?i)\bincondicional\b", r"(?i)\b(maestr[íi]a|doctorado|pregrado|licenciatura)\s+en\b", r"(?i)\bFacultad\s+de\b", r"(?i)\bcl[áa]usula\s+de\b",
]
#: Noise in extracted text, in the order of removal (the second needs look-ahead).
NOISE_PATTERNS = [
    r"\[\d+\]", r"\b\d{4}\b(?=\s*\))", r"https?://\S+", r"\b(?:doi|DOI):\s*\S+", r"(?im)^fig(?:ure|ura)?\.?\s*\d+", r"(?im)^tabla?\s*\d+", r"[^\S\n]{2,}", r"(?m)^[^\n]*?\.{3,}\s*\d{1,4}\s*$", r"(?m)^\s*\d{1,4}\s*$",
]
#: Lines that are no text (page headers, page of a document, captions) and verbs that a line of text has.
PAGE_HEADER = r"(?i)p(?:a|á)gina\s*\d+\s*de\s*\d+|page\s*\d+\s*of\s*\d+"
DOCUMENT_HEADER = r"(?i)(?:enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre|january|february|march|april|june|july|august|september|october|november|december).{0,60}p(?:a|á)gina\s*\d+"
CAPTION = r"(?i)^(?:ilustraci[oó]n|figura|figure|fig\.?|gr[aá]fico|image|imagen|cuadro|esquema|diagrama)\.?\s*\d+"
CONTENT_VERBS = r"(?i)(?:es|son|fue|fueron|tiene|tienen|propone|presenta|demuestra|permite|incluye|contiene|describe|analiza|muestra|obtiene|genera|produce|aplica)"
#: Headings, references and front matter among paragraphs.
BIBLIOGRAPHY_HEADING = r"(?i)^\s*(BIBLIOGRAF[ÍI]A|REFERENCIAS?|REFERENCES?|BIBLIOGRAPHY)\s*:?\s*$"
NUMBERED_REFERENCE = r"^\s*\d{1,3}\.\s+[A-ZÁÉÍÓÚÑ].*?\b(19|20)\d{2}\b"
FRONT_LINE = r"(?i)^\s*(Autores?|Afiliaciones?|Autor\s+para\s+correspondencia|Recibido|Aceptado|Publicado(\s+en)?|DOI|URL|Licencia|ISSN|Palabras\s+clave|Keywords)\b"
