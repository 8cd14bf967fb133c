"""The base corpus: ten fixed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "id string, conteudo string, metadata map<string,string>"

# The documents as (id, text, source, kind, area).
BASE = [
    ("lei_4504_art1",
     "Art. 1º Esta Lei regula os direitos e obrigações concernentes aos bens imóveis rurais, para os fins de execução da Reforma Agrária e promoção da Política Agrícola. § 1º Considera-se Reforma Agrária o conjunto de medidas que visem a promover melhor distribuição da terra, mediante modificações no regime de sua posse e uso, a fim de atender aos princípios de justiça social e ao aumento de produtividade.",
     "Lei 4.504/64 - Estatuto da Terra", "legislação", "direito_agrario"),
    ("lei_4504_art2",
     "Art. 2º É assegurada a todos a oportunidade de acesso à propriedade da terra, condicionada pela sua função social, na forma prevista nesta Lei. § 1º A propriedade da terra desempenha integralmente a sua função social quando, simultaneamente: a) favorece o bem-estar dos proprietários e dos trabalhadores que nela labutam, assim como de suas famílias; b) mantém níveis satisfatórios de produtividade; c) assegura a conservação dos recursos naturais; d) observa as disposições legais que regulam as justas relações de trabalho entre os que a possuem e a cultivem.",
     "Lei 4.504/64 - Estatuto da Terra", "legislação", "direito_agrario"),
    ("cf88_art184",
     "Art. 184. Compete à União desapropriar por interesse social, para fins de reforma agrária, o imóvel rural que não esteja cumprindo sua função social, mediante prévia e justa indenização em títulos da dívida agrária, com cláusula de preservação do valor real, resgatáveis no prazo de até vinte anos, a partir do segundo ano de sua emissão, e cuja utilização será definida em lei.",
     "Constituição Federal de 1988", "constituição", "direito_agrario"),
    ("cf88_art186",
     "Art. 186. A função social é cumprida quando a propriedade rural atende, simultaneamente, segundo critérios e graus de exigência estabelecidos em lei, aos seguintes requisitos: I - aproveitamento racional e adequado; II - utilização adequada dos recursos naturais disponíveis e preservação do meio ambiente; III - observância das disposições que regulam as relações de trabalho; IV - exploração que favoreça o bem-estar dos proprietários e dos trabalhadores.",
     "Constituição Federal de 1988", "constituição", "direito_agrario"),
    ("lei_8629_art6",
     "Art. 6º Considera-se propriedade produtiva aquela que, explorada econômica e racionalmente, atinge, simultaneamente, graus de utilização da terra e de eficiência na exploração, segundo índices fixados pelo órgão federal competente. § 1º O grau de utilização da terra, para efeito do caput deste artigo, deverá ser igual ou superior a 80%, calculado pela relação percentual entre a área efetivamente utilizada e a área aproveitável total do imóvel.",
     "Lei 8.629/93", "legislação", "direito_agrario"),
    ("lei_6938_art2",
     "Art. 2º A Política Nacional do Meio Ambiente tem por objetivo a preservação, melhoria e recuperação da qualidade ambiental propícia à vida, visando assegurar, no País, condições ao desenvolvimento socioeconômico, aos interesses da segurança nacional e à proteção da dignidade da vida humana.",
     "Lei 6.938/81 - Política Nacional do Meio Ambiente", "legislação", "direito_ambiental"),
    ("lei_9605_art38",
     "Art. 38. Destruir ou danificar floresta considerada de preservação permanente, mesmo que em formação, ou utilizá-la com infringência das normas de proteção: Pena - detenção, de um a três anos, ou multa, ou ambas as penas cumulativamente. Parágrafo único. Se o crime for culposo, a pena será reduzida à metade.",
     "Lei 9.605/98 - Crimes Ambientais", "legislação", "direito_ambiental"),
    ("lei_12651_art3",
     "Art. 3º Para os efeitos desta Lei, entende-se por: II - Área de Preservação Permanente (APP): área protegida, coberta ou não por vegetação nativa, com a função ambiental de preservar os recursos hídricos, a paisagem, a estabilidade geológica e a biodiversidade, facilitar o fluxo gênico de fauna e flora, proteger o solo e assegurar o bem-estar das populações humanas.",
     "Lei 12.651/12 - Código Florestal", "legislação", "direito_ambiental"),
    ("sumula_stj_456",
     "Súmula 456 do STJ: É legítima a cobrança de tarifa básica pelo uso dos serviços de telefonia fixa. O tribunal reconhece a constitucionalidade da cobrança mediante fundamentação em legislação infraconstitucional vigente.",
     "STJ - Súmula 456", "jurisprudência", "direito_civil"),
    ("stf_adi_3239",
     "ADI 3239 - Terras Quilombolas: O STF decidiu que o marco temporal para reconhecimento de terras quilombolas não deve se limitar à data da promulgação da CF/88, reconhecendo o direito de propriedade das comunidades quilombolas de forma ampla, com base no Art. 68 do ADCT.",
     "STF - ADI 3239", "jurisprudência", "direito_agrario"),
]

# The light engine's documents as (id, text, source, area).
CLIENT_BASE = [
    ("lei_4504_art1",
     "Art. 1º Esta Lei regula os direitos e obrigações concernentes aos bens imóveis rurais, para os fins de execução da Reforma Agrária e promoção da Política Agrícola. § 1º Considera-se Reforma Agrária o conjunto de medidas que visem a promover melhor distribuição da terra, mediante modificações no regime de sua posse e uso.",
     "Lei 4.504/64 - Estatuto da Terra", "direito_agrario"),
    ("lei_4504_art2",
     "Art. 2º É assegurada a todos a oportunidade de acesso à propriedade da terra, condicionada pela sua função social. § 1º A propriedade da terra desempenha integralmente a sua função social quando: a) favorece o bem-estar dos proprietários e trabalhadores; b) mantém níveis satisfatórios de produtividade; c) assegura a conservação dos recursos naturais; d) observa as disposições legais que regulam as justas relações de trabalho.",
     "Lei 4.504/64 - Estatuto da Terra", "direito_agrario"),
    ("cf88_art184",
     "Art. 184. Compete à União desapropriar por interesse social, para fins de reforma agrária, o imóvel rural que não esteja cumprindo sua função social, mediante prévia e justa indenização em títulos da dívida agrária.",
     "Constituição Federal 1988", "direito_agrario"),
    ("cf88_art186",
     "Art. 186. A função social é cumprida quando a propriedade rural atende: I - aproveitamento racional e adequado; II - utilização adequada dos recursos naturais e preservação do meio ambiente; III - observância das disposições que regulam as relações de trabalho; IV - exploração que favoreça o bem-estar.",
     "Constituição Federal 1988", "direito_agrario"),
    ("lei_8629_art6",
     "Art. 6º Considera-se propriedade produtiva aquela que, explorada econômica e racionalmente, atinge graus de utilização da terra e de eficiência na exploração. § 1º O grau de utilização da terra deverá ser igual ou superior a 80%.",
     "Lei 8.629/93", "direito_agrario"),
    ("lei_6938_art2",
     "Art. 2º A Política Nacional do Meio Ambiente tem por objetivo a preservação, melhoria e recuperação da qualidade ambiental propícia à vida, visando assegurar condições ao desenvolvimento socioeconômico e à proteção da dignidade da vida humana.",
     "Lei 6.938/81 - Política Nacional do Meio Ambiente", "direito_ambiental"),
    ("lei_9605_art38",
     "Art. 38. Destruir ou danificar floresta considerada de preservação permanente, mesmo que em formação, ou utilizá-la com infringência das normas de proteção: Pena - detenção, de um a três anos, ou multa, ou ambas cumulativamente.",
     "Lei 9.605/98 - Crimes Ambientais", "direito_ambiental"),
    ("lei_12651_art3",
     "Art. 3º Para os efeitos desta Lei, entende-se por: II - Área de Preservação Permanente (APP): área protegida, com a função ambiental de preservar os recursos hídricos, a paisagem, a estabilidade geológica e a biodiversidade.",
     "Lei 12.651/12 - Código Florestal", "direito_ambiental"),
    ("sumula_stj_456",
     "Súmula 456 do STJ: É legítima a cobrança de tarifa básica pelo uso dos serviços de telefonia fixa.",
     "STJ - Súmula 456", "direito_civil"),
    ("stf_adi_3239",
     "ADI 3239 - Terras Quilombolas: O STF decidiu que o marco temporal para reconhecimento de terras quilombolas não deve se limitar à data da promulgação da CF/88, reconhecendo o direito de propriedade das comunidades quilombolas.",
     "STF - ADI 3239", "direito_agrario"),
]


def base_documents(spark: SparkSession) -> DataFrame:
    """id, conteudo, metadata and doc_idx of the base."""
    rows = [(i, k, t, {"fonte": f, "tipo": p, "area": a}) for i, (k, t, f, p, a) in enumerate(BASE)]
    return spark.createDataFrame(rows, f"doc_idx long, {SCHEMA}")


def add_documents(base: DataFrame, docs: DataFrame, order_by: str = "id", replace: bool = True, earlier: DataFrame | None = None) -> DataFrame:
    """The corpus of the base and then docs (id, conteudo, metadata), with new doc_idx.

    Each call starts from the base: earlier additions are dropped unless replace is False and they are given.
    """
    if not replace and earlier is not None:
        docs = earlier.select("id", "conteudo", "metadata").unionByName(docs)
    start = base.count()
    return base.unionByName(numbered(docs, order_by, start))


def numbered(docs: DataFrame, order_by: str, start: int) -> DataFrame:
    """docs with doc_idx from start on, in order; ties go by the text.

    The order is cut at keys, and each row's range follows from its key alone, not from where it stands: counts and
    rows may be computed apart. The cuts are some keys with the least hashes, a few for each shuffle partition. Cuts
    and counts are subqueries, so that a query that does not ask for doc_idx does not pay for it.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = docs.select(F.col(order_by).alias("k")).where("k IS NOT NULL").distinct().orderBy(F.xxhash64("k")).limit(16 * parts)
    cuts = some.agg(F.filter(F.array_sort(F.collect_list("k")), lambda _, i: (i > 0) & (i % 16 == 0))).scalar()
    ranged = docs.withColumn("_cuts", cuts).withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= F.col(order_by)))).drop("_cuts")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.struct("_range", (before + start).alias("_offset")).alias("_o"))  # as many rows as cuts
    offset = F.element_at(offsets.agg(F.map_from_entries(F.collect_list("_o"))).scalar(), F.col("_range"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(order_by, "conteudo")) - 1
    return ranged.select((inside + offset).cast("long").alias("doc_idx"), "id", "conteudo", "metadata")


def chunks_as_documents(chunks: DataFrame) -> DataFrame:
    """Structural chunks as documents of the corpus; ids restart in each document, so the source is part of the key."""
    meta = F.create_map(F.lit("fonte"), F.col("fonte"), F.lit("tipo"), F.col("tipo"), F.lit("hierarquia"), F.array_join("hierarquia", " > "))
    return chunks.select(F.concat_ws("/", F.nullif(F.col("fonte"), F.lit("")), F.col("chunk_id")).alias("id"), "conteudo", meta.alias("metadata"))
