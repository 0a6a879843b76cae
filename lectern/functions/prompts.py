"""What language models are asked: instructions and examples."""

from __future__ import annotations

#: Fixed value: the instruction for telling contributions.
CONTRIBUTION_INSTRUCTION = """Eres un anotador experto en literatura científica en español. Tu tarea es decidir si un fragmento de texto contiene una contribución científica explícita del autor del trabajo donde aparece el fragmento.

Una CONTRIBUCIÓN CIENTÍFICA es un aporte original que el autor presenta como suyo: un método novedoso propuesto, un hallazgo empírico relevante obtenido en este trabajo, un avance conceptual o una herramienta desarrollada por el autor.

NO son contribuciones:
- Descripciones de antecedentes o trabajos previos de otros autores
- Métodos estándar de la disciplina (a menos que el autor los modifique)
- Resultados de experimentos previos citados como referencia
- Observaciones generales sin relación directa con el aporte del trabajo

Responde ÚNICAMENTE con una palabra: "SI" o "NO". No agregues explicaciones."""

#: Fixed value: the instruction for naming sections.
SECTION_INSTRUCTION = """Eres un asistente experto en analizar artículos científicos en español.
Tu tarea es clasificar el fragmento de texto en EXACTAMENTE UNA de estas 7 categorías:
- INTRO: Introducción, motivación, objetivos del estudio.
- BACK: Antecedentes, trabajos previos, estado del arte.
- METH: Metodología, diseño experimental, materiales, procedimientos.
- RES: Resultados obtenidos empíricamente (sin interpretación).
- DISC: Discusión, interpretación de resultados, implicaciones.
- LIM: Limitaciones del estudio, restricciones, sesgos.
- CONC: Conclusiones y trabajo futuro.

Nota: El texto contiene palabras reemplazadas por "[MASK]". Deduce la categoría basándote en la semántica del resto del texto.

Reglas: Responde ÚNICAMENTE con la sigla (ejemplo: INTRO, METH, DISC). Sin explicaciones."""

#: Fixed value: what is added where the answer has to be JSON.
JSON_INSTRUCTION = """

Responde en formato JSON: {"category": "SIGLA"}"""

#: Eight examples of contributions and others, in turn.
CONTRIBUTION_EXAMPLES = (
    ("SI", "En este artículo presentamos Graphformer-V2, una arquitectura que integra atención local-global mediante un mecanismo de ventanas dinámicas y grafos adaptativos. A diferencia de los Graph Transformers anteriores, nuestro modelo reduce la complejidad cuadrática a lineal-logarítmica mediante un muestreo jerárquico de nodos. Logramos un nuevo estado del arte en ocho benchmarks de grafos (incluyendo ogbg-molpcba y PCQM4Mv2) con un 12% menos de parámetros y 47% menos FLOPs que el mejor modelo previo. Además, demostramos una mejor generalización en escenarios de distribución fuera del dominio."),
    ("NO", "Este trabajo revisa los principales avances en el campo del aprendizaje profundo aplicados a la detección de fraudes bancarios durante los últimos cinco años. Analizamos 34 artículos relevantes y comparamos el rendimiento de CNN, LSTM y modelos basados en Transformers. Los resultados confirman que los modelos más recientes obtienen mejor desempeño, aunque siguen existiendo desafíos en cuanto a interpretabilidad y datos desbalanceados. Se discuten posibles direcciones futuras."),
    ("SI", "Desarrollamos un nuevo inhibidor covalente (BTK-CI-23) altamente selectivo contra la tirosina quinasa de Bruton. El compuesto muestra una IC50 de 0.8 nM y más de 500 veces de selectividad sobre otras quinasas TEC. En modelos de xenoinjerto de linfoma de células del manto, logró una regresión tumoral completa en el 83% de los casos con dosificación oral diaria. La novedad radica en el diseño de un pocket alostérico que reduce significativamente los efectos off-target observados en inhibidores de primera y segunda generación."),
    ("NO", "Implementamos un modelo BERT fine-tuned para clasificar reseñas de productos en español. Utilizamos un dataset de 15.000 reseñas recolectadas de Mercado Libre. El modelo alcanzó una accuracy del 87.3% y un F1-score de 0.85. Estos resultados son consistentes con lo reportado en la literatura para tareas similares de análisis de sentimiento. Realizamos experimentos de ablación para validar la importancia del preprocesamiento de texto."),
    ("SI", "Proponemos un método de alineación multimodal (CrossModal-DPO) que alinea modelos de lenguaje con videos sin necesidad de anotaciones humanas. Mediante la optimización directa de preferencia en pares video-texto generados automáticamente, superamos en 9.4 puntos el estado del arte en tareas de VideoQA y recuperación texto-video en MSRVTT y ActivityNet. El modelo demuestra emergente razonamiento espacio-temporal sin entrenamiento supervisado explícito en estas capacidades."),
    ("NO", "En este estudio comparamos el rendimiento de cinco algoritmos de optimización (Adam, RMSprop, SGD, AdamW y Lion) en el entrenamiento de redes residuales ResNet-50 sobre ImageNet. Nuestros experimentos confirman que AdamW ofrece el mejor balance entre velocidad de convergencia y precisión final, resultados similares a los encontrados en trabajos previos. Se proporcionan recomendaciones prácticas para investigadores."),
    ("SI", "Presentamos evidencias de que la suplementación con urolitina A mitocondrial durante 16 semanas revierte significativamente el declive muscular en adultos mayores de 65 años. El ensayo doble ciego con 120 participantes mostró un aumento del 38% en fuerza de piernas y una mejora del 27% en rendimiento mitocondrial medido por biopsia. Este es el primer estudio en humanos que demuestra reversión de sarcopenia mediante modulación de mitofagia en población anciana."),
    ("NO", "Aplicamos técnicas estándar de machine learning para predecir el precio de viviendas en Bogotá usando datos abiertos del distrito. El modelo XGBoost obtuvo un MAE de 18.4 millones de pesos. Este trabajo sirve como benchmark local y confirma que las variables de ubicación, área y estrato socioeconómico siguen siendo las más predictivas, en línea con la literatura internacional."),
)

#: Two examples of each section.
SECTION_EXAMPLES = (
    ("INTRO", "Este estudio busca evaluar el impacto de las redes neuronales en la detección de fallas en sistemas industriales."),
    ("INTRO", "El presente trabajo se enmarca en el contexto de la creciente demanda de soluciones automatizadas para la clasificación documental."),
    ("BACK", "Investigaciones previas de Smith et al. (2022) sugirieron que el litio es inestable en estas condiciones de presión."),
    ("BACK", "Diversos autores han abordado el problema desde el enfoque de aprendizaje supervisado, destacando los trabajos de Pérez (2019) y García (2021)."),
    ("METH", "Se utilizó un diseño experimental de bloques al azar con tres repeticiones por tratamiento y análisis ANOVA de dos vías."),
    ("METH", "Para el procesamiento se aplicó un pipeline de tokenización, lematización con spaCy y vectorización TF-IDF previa al modelado."),
    ("RES", "La tasa de error disminuyó significativamente de 0.85 a 0.12 tras la optimización del modelo (p<0.01)."),
    ("RES", "Se observó una correlación positiva (r=0.78) entre las variables analizadas en los 245 sujetos del estudio."),
    ("DISC", "Estos hallazgos sugieren que la presión atmosférica influye más de lo esperado, lo cual contradice estudios anteriores."),
    ("DISC", "La interpretación de estos resultados debe considerar el contexto socioeconómico de la población muestreada."),
    ("LIM", "Debido al tamaño reducido de la muestra, los resultados no pueden generalizarse a toda la población latinoamericana."),
    ("LIM", "Una restricción importante fue la imposibilidad de acceder a datos longitudinales superiores a tres años."),
    ("CONC", "En conclusión, el sistema propuesto es viable para implementaciones industriales a gran escala con margen de error aceptable."),
    ("CONC", "Finalmente, se recomienda continuar investigando el efecto a largo plazo en estudios con muestras más amplias."),
)


def opening(task: str, examples: bool, as_json: bool = False) -> list[tuple[str, str]]:
    """(role, content) of all that stands before the text in question.  task: ``section`` or ``yes_no``.

    Contributions take their examples as turns of a conversation, sections as a block of the instruction.
    """
    if task == "yes_no":
        turns = [t for answer, text in CONTRIBUTION_EXAMPLES for t in (("user", f"Fragmento:\n{text}\n\nRespuesta:"), ("assistant", answer))]
        return [("system", CONTRIBUTION_INSTRUCTION), *(turns if examples else [])]
    block = "\n\nAquí tienes ejemplos de clasificación correcta:\n" + "".join(f'\nFragmento: "{text}"\nCategoría: {label}\n' for label, text in SECTION_EXAMPLES)
    return [("system", SECTION_INSTRUCTION + (block if examples else "") + (JSON_INSTRUCTION if as_json else ""))]


#: How the text in question is put, around it.
QUESTION = {"yes_no": ("Fragmento:\n", "\n\nRespuesta:"), "section": ('Fragmento: "', '"')}
