"""Domain data of the clinical cohort: closed value domains, bands, and rule presets. Operators take all of it as parameters."""

from __future__ import annotations

# Names, labels and closed domains of the cohort's variables.
ID_COLUMN, TARGET = "id_pacie", "ana_dura"
POSITIVE, NEGATIVE, NOT_STUDIED, MISSING = "Buscada positivo", "Buscada negativo", "No buscada", "Missing"
SPEC_HEADER = "Nombre variable"
YES_NO = ("Sí", "No")
ENUM_DOMAINS: dict[str, tuple[str, ...]] = {
    "sexo": ("Hombre", "Mujer"),
    "raza": ("Caucásica", "América Latina", "Negra", "Asiática", "Romaní", "Arábica", "Otras"),
    "sin_tvp_": ("EP", "EP+TVP", "TVP/EP", "TVP", "TVS", "Asintomático"),
    "ep_tac_r": ("Normal", "Trombosis", "Embolia Pulmonar"),
    "tvp_eco_": ("Normal", "Trombosis"),
    "tvp_orig": ("Secundaria a catéter", "No secundaria a catéter"),
    "tvp_prox": ("Proximal", "Distal", "Proximal (incluyendo la vena poplítea)", "Distal (excluyendo la vena poplítea)"),
    "ana_dime": ("Positivo", "Negativo", "No practicado"),
}
YES_NO_COLUMNS = (
    "eptacven ep_t_reg ep_ecoca ep_eco_v var52 epecoddv tv_l_esu tv_l_ein tv_l_vpo tv_l_vme tv_l_ves tv_l_svc tv_l_vre "
    "tv_l_vrn tv_l_vca tv_l_yug tv_l_ova tv_l_sup tv_l_pul tv_l_ove ant_inf ant_isq ant_clau fum_act diabetes hip_art "
    "insf_car fibr_aur trat_est e_con_pp e_con_cu e_con_ec e_con_lu e_con_af e_con_be e_con_at e_con_va e_con_ar e_con_ea "
    "e_con_pr e_con_ro e_con_av e_con_sm var171 fr_cance fr_cirug fr_inmov fr_tvp_a fr_antfa fr_tvs_a fr_viaje fr_estro "
    "fr_embar fr_varic fr_antec evn_defu evn_reci evn_rec2 evn_rec3 evn_rec4 evn_hemo evn_hem2 evn_hem3 evn_hem4 eisq_art "
    "eisq_inf eisq_ang eisq_cer eisq_ei eisq_ol"
).split()
ENUM_DOMAINS |= {name: YES_NO for name in YES_NO_COLUMNS}

#: Recodes that a curated selection applies: (column, from, to).
SELECTION_RECODES = (("sin_tvp_", "TVP/EP", "EP+TVP"),)
SEX_RECODE = {"Hombre": "Male", "Mujer": "Female"}
HISTORY_PREFIXES = ("fr_", "sin_", "ant_")

#: First-match-wins recodes as SQL cases: name -> ((condition, value) ..., default).
CASE_RECODES: dict[str, tuple[tuple[tuple[str, str], ...], str]] = {
    "edadC": ((("edad < 50", "Joven"), ("edad >= 50 AND edad < 70", "Medio"), ("edad >= 70", "Senior"), ("sexo = 'Mujer' AND edad < 45", "Fertil")), "Normal"),
    "pesoC": ((("peso > 100", "Alto"), ("peso < 50", "Bajo")), "Normal"),
    "tensionC": ((("tension_ < 100", "Baja"),), "Normal"),
    "fr_can_eC": (
        (
            ("fr_cance = 'Sí' AND fr_can_e = 'Con metástasis'", "Con metástasis"),
            ("fr_cance = 'Sí' AND fr_can_e = 'Sin metástasis'", "Sin metástasis"),
            ("fr_cance = 'Sí' AND fr_can_e = 'NS/NC'", "No definido"),
            ("fr_cance = 'Sí' AND fr_can_e IS NULL", "No definido"),
            ("fr_cance = 'No'", "No"),
        ),
        "0",
    ),
    "ana_hemoC": ((("ana_hemo < 12", "Bajo"), ("ana_hemo >= 12 OR ana_hemo IS NULL", "Normal")), "0"),
    "ana_plaqC": (
        (
            ("ana_plaq < 140", "Bajo"),
            ("ana_plaq >= 140 AND ana_plaq < 400", "Normal"),
            ("ana_plaq >= 400 AND ana_plaq < 140000", "Alto"),
            ("ana_plaq > 140000 AND ana_plaq < 400000", "Normal"),
            ("ana_plaq > 400000", "Alto"),
            ("ana_plaq IS NULL", "Normal"),
        ),
        "0",
    ),
    "ana_neuC": ((("ana_neu < 2.5", "Bajo"), ("ana_neu > 12", "Alto"), ("ana_neu IS NULL OR ana_neu BETWEEN 2.5 AND 12", "Normal")), "0"),
    "ana_leucC": ((("ana_leuc < 4.5", "Bajo"), ("ana_leuc > 11", "Alto"), ("ana_leuc IS NULL OR ana_leuc BETWEEN 4.5 AND 11", "Normal")), "0"),
    "ana_dimeC": ((("ana_dime = 'Positivo'", "Positivo"), ("ana_dime = 'Negativo'", "Negativo"), ("ana_dime = 'No practicado' OR ana_dime IS NULL", "No practicado")), "0"),
    "ana_creaC": ((("ana_crea = 'Elevada'", "Elevada"), ("ana_crea = 'Normal' OR ana_crea IS NULL", "Normal")), "0"),
}

#: Association-guided rules: name -> alternatives (needed column, SQL predicate); the first whose column exists is used.
GUIDED_RULES: dict[str, tuple[tuple[str, str], ...]] = {
    "female_sex_rule": (("sexo", "sexo IN ('Female', 'Mujer')"),),
    "age_lt50_rule": (("edad", "try_cast(edad AS double) < 50"),),
    "age_50_69_rule": (("edad", "try_cast(edad AS double) BETWEEN 50 AND 69"),),
    "no_prior_dvt_rule": (("fr_tvp_p", "coalesce(try_cast(fr_tvp_p AS double), 0) <= 0"), ("fr_tvp_a", "fr_tvp_a = 'No'")),
    "normal_hemoglobin_rule": (("ana_hemo", "try_cast(ana_hemo AS double) >= 12"),),
    "negative_ddimer_rule": (("ddvalmcg", "try_cast(ddvalmcg AS double) <= 0.5"), ("ana_dime", "ana_dime = 'Negativo'")),
    "no_malignancy_rule": (("fr_cance", "fr_cance = 'No'"),),
    "no_immobilization_rule": (("fr_inmov", "fr_inmov = 'No'"),),
}
