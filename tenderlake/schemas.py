"""The catalogue's tables: columns, keys, references with what a deletion does, and rules for values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

CASCADE, SET_NULL = "cascade", "set null"
MONEY = T.DecimalType(15, 2)
_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "str": T.StringType(), "date": T.DateType(), "ts": T.TimestampType(), "money": MONEY, "bool": T.BooleanType()}


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    nullable: bool = False
    unique: bool = False
    max_length: int | None = None
    form: str | None = None


@dataclass(frozen=True)
class Reference:
    column: str
    target: str
    on_delete: str


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    key: str = "id"
    references: tuple[Reference, ...] = ()
    #: By which rows a get-or-create finds an existing one.
    natural_key: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, _TYPES[c.kind], c.nullable) for c in self.columns])

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)


def _columns(text: str) -> tuple[Column, ...]:
    """``name type[length][?][U][@form]`` items: ``?`` may be null, ``U`` unique."""
    out = []
    for item in text.split(","):
        name, spec = item.split()
        spec, _, form = spec.partition("@")
        unique, nullable = "U" in spec, "?" in spec
        kind = spec.replace("U", "").replace("?", "")
        size = kind.removeprefix("str") if kind.startswith("str") else ""
        out.append(Column(name, "str" if size or kind == "str" else kind, nullable, unique, int(size) if size else None, form or None))
    return tuple(out)


TABLES: dict[str, Table] = {
    t.name: t
    for t in (
        Table("publication", _columns("id long, titre str255, numero str100, date_publication date, source str255, source_url str200?@url, type_publication str100?"), natural_key=("numero",)),
        Table("type_procedure", _columns("id long, libelle str100U, description str?"), natural_key=("libelle",)),
        Table(
            "marche",
            _columns("id long, publication_id long, type_procedure_id long?, ministere str255?, region str100?, objet str, budget_min money?, budget_max money?"),
            references=(Reference("publication_id", "publication", CASCADE), Reference("type_procedure_id", "type_procedure", SET_NULL)),
            natural_key=("publication_id", "objet"),
        ),
        Table(
            "appel_offre",
            _columns("marche_ptr_id long, dateDepot date?, referenceDossier str255?, lieuDepot str?, conditionsParticipation str?, criteresSelection str?, cautionnement money?, dureeValiditeOffres str255?"),
            key="marche_ptr_id",
            references=(Reference("marche_ptr_id", "marche", CASCADE),),
        ),
        Table(
            "resultat",
            _columns("marche_id long, date_attribution date?, entreprise_attributaire_id long?, montant_attribue money?, reference_decision str255?, nombre_offres_recues int?, delai_execution str255?, motif_rejet_autres_offres str?"),
            key="marche_id",
            references=(Reference("marche_id", "marche", CASCADE), Reference("entreprise_attributaire_id", "entreprise", SET_NULL)),
            natural_key=("marche_id",),
        ),
        Table("lot", _columns("id long, marche_id long, numero_lot int, description str?, montant money?"), references=(Reference("marche_id", "marche", CASCADE),), natural_key=("marche_id", "numero_lot")),
        Table(
            "alerte",
            _columns("id long, entreprise_id long, publication_id long, type_alerte str50, date_alerte ts, contenu_alerte str, canal_alerte str30"),
            references=(Reference("entreprise_id", "entreprise", CASCADE), Reference("publication_id", "publication", CASCADE)),
        ),
        Table(
            "publication_domaine",
            _columns("id long, publication_id long, domaine_id long"),
            references=(Reference("publication_id", "publication", CASCADE), Reference("domaine_id", "domaine", CASCADE)),
            natural_key=("publication_id", "domaine_id"),
        ),
        Table("domaine", _columns("id long, libelle str100U, description str?"), natural_key=("libelle",)),
        Table("secteur_activite", _columns("id long, nom str100U, description str?"), natural_key=("nom",)),
        Table(
            "entreprise",
            _columns("id long, nom str255, numero_identification str100U, siret str20U, adresse str255?, telephone str50?, email str254?@email, date_creation date?, description str?, repnom str255?, repprenom str255, rccm str15?"),
            natural_key=("nom",),
        ),
        Table("entreprise_domaine", _columns("id long, entreprise_id long, domaine_id long"), references=(Reference("entreprise_id", "entreprise", CASCADE), Reference("domaine_id", "domaine", CASCADE)), natural_key=("entreprise_id", "domaine_id")),
        Table("entreprise_secteur", _columns("id long, entreprise_id long, secteur_id long"), references=(Reference("entreprise_id", "entreprise", CASCADE), Reference("secteur_id", "secteur_activite", CASCADE)), natural_key=("entreprise_id", "secteur_id")),
        Table(
            "utilisateur",
            _columns("id long, email strU@email, first_name str150, last_name str150, entreprise_id long?, telephone str50?, notifications_actives bool"),
            references=(Reference("entreprise_id", "entreprise", SET_NULL),),
        ),
    )
}

#: A batch of extraction payloads. Every section may be null.
PAYLOAD = """
arrival long,
entreprise struct<nom: string, numero_identification: string, siret: string, adresse: string, telephone: string, email: string,
  date_creation: date, description: string, repnom: string, repprenom: string, rccm: string, domaines: array<string>, secteurs: array<string>>,
domaine string,
type_procedure string,
publication struct<numero: string, titre: string, date_publication: date, source: string, source_url: string, type_publication: string>,
marche struct<objet: string, ministere: string, region: string, budget_min: decimal(15,2), budget_max: decimal(15,2)>,
lots array<struct<numero_lot: int, description: string, montant: decimal(15,2)>>,
resultat struct<date_attribution: date, montant_attribue: decimal(15,2), reference_decision: string, nombre_offres_recues: int,
  delai_execution: string, motif_rejet_autres_offres: string>,
alerte struct<type_alerte: string, date_alerte: timestamp, contenu_alerte: string, canal_alerte: string>
"""
