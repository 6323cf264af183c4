"""The query service: for each resource its rows, what may be searched and ordered, and the nested form it is shown in.

A request filters and orders flat rows, the columns of joined tables that it may search beside them; only what is left is nested. So
predicates reach the scans, and one plan serves the whole request, however deep the records are.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderlake.operators.nesting import nest_many, nest_one, nest_through
from tenderlake.operators.ordering import order
from tenderlake.operators.search import search
from tenderlake.sources.files import to_json_rows

Tables = Mapping[str, DataFrame]

PUBLICATION = ["id", "titre", "numero", "date_publication", "source", "type_publication", "domaines"]
LABEL = ["id", "libelle", "description"]
SECTOR = ["id", "nom", "description"]
LOT = ["id", "marche", "numero_lot", "description", "montant"]
MARCHE = ["id", "publication", "type_procedure", "ministere", "region", "objet", "budget_min", "budget_max", "lots"]
TENDER = ["dateDepot", "referenceDossier", "lieuDepot", "conditionsParticipation", "criteresSelection", "cautionnement", "dureeValiditeOffres"]
RESULT = ["marche", "date_attribution", "entreprise_attributaire", "montant_attribue", "reference_decision", "nombre_offres_recues", "delai_execution", "motif_rejet_autres_offres"]
COMPANY = ["id", "nom", "numero_identification", "siret", "adresse", "telephone", "email", "date_creation", "description", "repnom", "repprenom", "rccm", "domaines", "secteurs"]
ALERT = ["id", "entreprise", "publication", "type_alerte", "date_alerte", "contenu_alerte", "canal_alerte"]
USER = ["id", "email", "first_name", "last_name", "telephone", "notifications_actives", "entreprise"]


def publications(t: Tables, rows: DataFrame) -> DataFrame:
    return nest_through(rows, t["publication_domaine"], t["domaine"], ("id", "publication_id"), ("domaine_id", "id"), "domaines", LABEL).select(*_kept(rows), *PUBLICATION)


def lots(t: Tables, rows: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("marche_id", "marche").select(*_kept(rows), *LOT)


def marches(t: Tables, rows: DataFrame, more: list[str] | None = None) -> DataFrame:
    df = nest_one(rows, publications(t, t["publication"]), ("publication_id", "id"), "publication", PUBLICATION, required=True)
    df = nest_one(df, t["type_procedure"], ("type_procedure_id", "id"), "type_procedure", ["id", "libelle"])
    df = nest_many(df, lots(t, t["lot"]), ("id", "marche"), "lots", LOT)
    return df.select(*_kept(rows), *MARCHE, *(more or []))


def tenders(t: Tables, rows: DataFrame) -> DataFrame:
    return marches(t, rows, TENDER)


def companies(t: Tables, rows: DataFrame) -> DataFrame:
    """Two relations, each gathered by itself: joining both bridges at once would multiply their rows."""
    df = nest_through(rows, t["entreprise_domaine"], t["domaine"], ("id", "entreprise_id"), ("domaine_id", "id"), "domaines", LABEL)
    df = nest_through(df, t["entreprise_secteur"], t["secteur_activite"], ("id", "entreprise_id"), ("secteur_id", "id"), "secteurs", SECTOR)
    return df.select(*_kept(rows), *COMPANY)


def results(t: Tables, rows: DataFrame) -> DataFrame:
    df = nest_one(rows, marches(t, t["marche"]), ("marche_id", "id"), "marche", MARCHE, required=True)
    df = nest_one(df, companies(t, t["entreprise"]), ("entreprise_attributaire_id", "id"), "entreprise_attributaire", COMPANY)
    return df.select(*_kept(rows), *RESULT)


def alerts(t: Tables, rows: DataFrame) -> DataFrame:
    df = nest_one(rows, companies(t, t["entreprise"]), ("entreprise_id", "id"), "entreprise", COMPANY, required=True)
    df = nest_one(df, publications(t, t["publication"]), ("publication_id", "id"), "publication", PUBLICATION, required=True)
    return df.select(*_kept(rows), *ALERT)


def profiles(t: Tables, rows: DataFrame) -> DataFrame:
    return rows.select(*_kept(rows), "email", "first_name", "last_name")


def users(t: Tables, rows: DataFrame) -> DataFrame:
    """Users with their company; one without is shown with null."""
    df = nest_one(rows, companies(t, t["entreprise"]), ("entreprise_id", "id"), "entreprise", COMPANY)
    return df.select(*_kept(rows), *USER)


def linked(table: str, column: str, name: str, fields: list[str]) -> Callable[[Tables, DataFrame], DataFrame]:
    """Rows of a bridge with what they lead to."""
    return lambda t, rows: nest_one(rows, t[table], (column, "id"), name, fields, required=True).select(*_kept(rows), "id", name)


def plain(*columns: str) -> Callable[[Tables, DataFrame], DataFrame]:
    return lambda t, rows: rows.select(*_kept(rows), *columns)


def _kept(rows: DataFrame) -> list[str]:
    """Columns by which rows are put in order after they are nested."""
    return [c for c in rows.columns if c.startswith("_sort")]


@dataclass(frozen=True)
class Resource:
    """``rows`` gives the flat rows; ``joined_search`` maps names of searched columns to where they come from: (reference, table, column)."""

    table: str
    present: Callable[[Tables, DataFrame], DataFrame]
    search: tuple[str, ...] = ()
    ordering: tuple[str, ...] = ()
    default: str | None = None
    key: str = "id"
    joined_search: tuple[tuple[str, str, str, str], ...] = ()
    parent: tuple[str, str] | None = None

    def rows(self, t: Tables) -> DataFrame:
        df = t[self.table]
        if self.parent:  # the columns of an inherited record
            name, key = self.parent
            df = df.join(t[name], df[self.key] == t[name][key])
        for alias, reference, table, column in self.joined_search:
            side = t[table].select(F.col("id").alias("_id"), F.col(column).alias(alias))
            # Left: a row whose reference is null can still match in another field.
            df = df.join(side, df[reference] == side["_id"], "left").drop("_id")
        return df


RESOURCES: dict[str, Resource] = {
    "publications": Resource("publication", publications, ("titre", "numero", "source"), ("date_publication",), "-date_publication"),
    "types-procedure": Resource("type_procedure", plain("id", "libelle")),
    "marches": Resource("marche", marches, ("objet", "ministere", "region"), ("budget_min", "budget_max")),
    "appels-offres": Resource("appel_offre", tenders, ("objet", "referenceDossier", "lieuDepot"), ("dateDepot",), key="marche_ptr_id", parent=("marche", "id")),
    "resultats": Resource(
        "resultat",
        results,
        ("_search_objet", "_search_nom"),
        ("date_attribution", "montant_attribue"),
        key="marche_id",
        joined_search=(("_search_objet", "marche_id", "marche", "objet"), ("_search_nom", "entreprise_attributaire_id", "entreprise", "nom")),
    ),
    "lots": Resource("lot", lots, ("description",), ("numero_lot", "montant")),
    "domaines": Resource("domaine", plain(*LABEL)),
    "secteurs": Resource("secteur_activite", plain(*SECTOR)),
    "publications-domaines": Resource("publication_domaine", plain("id", "publication_id", "domaine_id")),
    "alertes": Resource("alerte", alerts, ("type_alerte", "contenu_alerte"), ("date_alerte",)),
    "entreprises": Resource("entreprise", companies),
    "entreprises-domaines": Resource("entreprise_domaine", linked("domaine", "domaine_id", "domaine", LABEL)),
    "entreprises-secteurs": Resource("entreprise_secteur", linked("secteur_activite", "secteur_id", "secteur", SECTOR)),
    "utilisateurs": Resource("utilisateur", users),
    "profil": Resource("utilisateur", profiles),
    # The administration's lists.
    "admin-entreprises": Resource("entreprise", plain("nom", "numero_identification", "siret", "email", "telephone", "date_creation"), ("nom", "numero_identification", "siret", "email", "repnom", "repprenom"), default="nom"),
    "admin-domaines": Resource("domaine", plain("libelle", "description"), ("libelle",)),
    "admin-secteurs": Resource("secteur_activite", plain("nom", "description"), ("nom",)),
}


def list_resource(t: Tables, name: str, query: str | None = None, ordering: str | None = None) -> DataFrame:
    """All rows of a resource that match the search, nested and in order. Orders that the resource doesn't allow are dropped without a word."""
    r = RESOURCES[name]
    found = search(r.rows(t), query, r.search) if r.search else r.rows(t)
    # Sort keys travel through the nesting under names of their own, so what is shown needn't have them.
    held = list(dict.fromkeys([*r.ordering, *([r.default.lstrip("-")] if r.default else []), r.key]))
    shown = r.present(t, found.select("*", *(F.col(c).alias(f"_sort_{c}") for c in held)))
    renamed = lambda text: ",".join(f"-_sort_{x[1:]}" if x[0] == "-" else f"_sort_{x}" for x in map(str.strip, (text or "").split(",")) if x)
    ordered = order(shown, renamed(ordering), [f"_sort_{c}" for c in r.ordering], renamed(r.default) or None, (f"_sort_{r.key}",))
    return ordered.drop(*(f"_sort_{c}" for c in held))


def detail(t: Tables, name: str, key: int) -> DataFrame:
    """The one row of that key, nested; empty if there is none."""
    r = RESOURCES[name]
    return r.present(t, r.rows(t).where(F.col(r.key) == key))


def response(df: DataFrame) -> DataFrame:
    """Rows as JSON texts."""
    return to_json_rows(df)
