"""Declared schemas of the raw files; nothing is inferred at read time."""

from __future__ import annotations

INSTALLATION = (
    "id string, name string, registry_id string, activity_id int, isAircraftOperator boolean, "
    "isMaritimeOperator boolean, parentCompany string, nace_id string, latitudeGoogle double, "
    "longitudeGoogle double"
)
COMPLIANCE = (
    "installation_id string, year int, euetsPhase string, compliance_id string, verified double, "
    "allocatedTotal double, verifiedCummulative double"
)
ACCOUNT = (
    "accountType_id string, installation_id string, bvdId string, "
    "companyRegistrationNumber string, isOpen boolean"
)
POLICY_INDEX = "CLIM_POL string, REF_AREA string, TIME_PERIOD int, OBS_VALUE double"
DEMOCRACY_INDEX = (
    "country_text_id string, year int, v2x_polyarchy double, v2x_libdem double, v2x_corr double"
)
PLANT_UNITS = (
    "eic_p string, eic_g string, name_p string, country string, lat double, lon double, "
    "type_g string, capacity_p double"
)

#: Names of the firm export columns behind the library's short names.
FIRM_COLUMNS = {
    "bvdId": "BvD ID number",
    "company_name": "Company name Latin alphabet",
    "country": "Country ISO code",
    "nace": "NACE Rev. 2, core code (4 digits)",
    "legal_form": "Standardized legal form",
    "independence": "OUB - Independence indicator",
    "incorporation_date": "Date of incorporation",
    "guo_name": "GUO - Name",
    "guo_type": "GUO - Type",
    "guo_country": "GUO - Country ISO code",
    "guo_direct_pct": "GUO - Direct %",
    "guo_total_pct": "GUO - Total %",
    "quoted": "Quoted",
}

#: Wide yearly families of the firm export.
FIRM_FAMILIES = {
    "total_assets": "Total assets",
    "operating_revenue": "Operating revenue",
    "n_employees": "Number of employees",
}
