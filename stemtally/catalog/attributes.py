"""Attributes of the published histograms: their levels and recodes.

Text entries are fixed values. One line per recode: ``name = label: levels |
label: levels``; levels are numbers and ranges. ``levels`` lists the labels in
order. Long lists follow rules further down.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations, product

# ---- fixed values ---------------------------------------------------------------------------

TEXT = """
[agecat AgecatAttr]
levels = Under 5 years | 5 to 9 years | 10 to 14 years | 15 to 17 years | 18 to 19 years | 20 to 21 years | 22 to 24 years | 25 to 29 years | 30 to 34 years | 35 to 39 years | 40 to 44 years | 45 to 49 years | 50 to 54 years | 55 to 59 years | 60 to 61 years | 62 to 64 years | 65 years | 66 years | 67 to 69 years | 70 to 74 years | 75 to 79 years | 80 to 84 years | 85 years and over
votingage = Non-voting age: 0-3 | Voting age: 4-22
voting = Voting age: 4-22
nonvoting = Non-voting age: 0-3

[citizen CitizenAttr]
levels = Non-citizen | Citizen

[h1 H1Attr]
levels = Vacant | Occupied
vacant_count = Vacant: 0

[hhage HHAgeAttr]
levels = Householder 15 to 24 years | Householder 25 to 34 years | Householder 35 to 44 years | Householder 45 to 54 years | Householder 55 to 59 years | Householder 60 to 64 years | Householder 65 to 74 years | Householder 75 to 84 years | Householder 85 years and over
age_15to24 = Householder age is 15 to 24: 0
hhover24 = Householder age is over 24: 1-8
age_60plus = Householder age is 60 or more: 5-8
age_under60 = Householder age is under 60: 0-4
age_60to64 = Householder age is 60 to 64: 5
age_65to74 = Householder age is 65 to 74: 6
age_75plus = Householder age is 75 or older: 7-8
hhover65 = 15 to 64 years: 0-5 | 65 years and over: 6-8
hhageH18 = Householder 15 to 34 years: 0-1 | Householder 35 to 64 years: 2-5 | Householder 65 years and over: 6-8

[elderly HHElderlyAttr]
levels = None | At least one 60+ year old person, no one 65+ | At least one 65+ year old person, no one 75+ | At least one 75+ year old person
invert_elderly0 = At least one person over 60 present: 1-3
invert_elderly1 = No one below 60 present or someone over 64 present: 0,2,3
invert_elderly2 = No one below 65 present or someone over 74 present: 0,1,3
invert_elderly3 = No one 75+ present: 0-2
pres_under65 = No one 65+ present: 0-1
pres_under60 = No one 60 or older: 0
elderly3 = Someone 75+ present: 3
presence60 = No one over 60: 0 | At least one over 60: 1-3
presence65 = No one over 65 years: 0-1 | At least one person over 65 years: 2-3
presence75 = No one over 75 years: 0-2 | At least one person over 75 years: 3

[hhgq HHGQAttr]
levels = Household | {GQ24}
housing_units = Housing Units: 0
hhgq_vector = each 0-24
total_gq = Group Quarters: 1-24
hhgqMajorTypes = GQ 101-106 Correctional facilities for adults: 1-6 | GQ 201-203 Juvenile facilities: 7-9 | GQ 301 Nursing facilities/Skilled-nursing facilities: 10 | GQ 401-405 Other institutional facilities: 11-15 | GQ 501 College/University student housing: 16 | GQ 601-602 Military quarters: 17-18 | GQ 701-702, 704, 706, 801-802, 900-901, 903-904 Other noninstitutional facilities: 19-24
hhgqSpineTypes = same hhgqMajorTypes
hhgqInstNoninst = GQ 101-106, 201-203, 301, 405-105 Institutionalized population: 1-15 | GQ 501, 601-602, 701-702, 704, 706, 801-802, 900-901, 903-904 Noninstitutionalized population: 16-24
gqlevels = each 1-24

[hhgq1940 HHGQ1940Attr]
levels = Household | Correctional Institutions | Mental Institutions | Institutions for the Elderly, Handicapped, and Poor | Military | College Dormitory | Rooming House | Other Non-Institutional GQ and Unknown
household = Household: 0
hhgq_2level = Household: 0 | Group Quarters: 1-7
gqlevels = each 1-7
instlevels = Institutional Facility: 1-3 | Non-Institutional Facility: 4-7
gqTotal = Total Population in Group Quarters: 1-7
instTotal = Institutional Population Total: 1-3
gqCorrectionalTotal = Correctional Institutions Total: 1
gqMentalTotal = Mental Institutions Total: 2
gqElderlyTotal = Institutions for the Elderly, Handicapped, and Poor Total: 3
noninstTotal = Noninstitutionalized Population Total: 4-7
gqMilitaryTotal = Military Total: 4
gqCollegeTotal = College Dormitory Total: 5
gqRoomingTotal = Rooming House Total: 6
gqOtherNoninstTotal = Other Non-Institutional GQ and Unknown Total: 7

[hhgq HHGQPersonSimpleAttr]
levels = Household | Correctional facilities for adults | Juvenile facilities | Nursing facilities/Skilled-nursing facilities | Other institutional facilities | College/University student housing | Military quarters | Other noninstitutional facilities
householdTotal = Household: 0
hhgq_2level = Household: 0 | Group Quarters: 1-7
gqlevels = each 1-7
instlevels = Institutional Facility: 1-4 | Non-Institutional Facility: 5-7
hhinstlevels = Household: 0 | Institutional Facility: 1-4 | Non-Institutional Facility: 5-7
gqTotal = Total Population in Group Quarters: 1-7
instTotal = Institutional Population Total: 1-4
gqCorrectionalTotal = Correctional Facilities for Adults Population Total: 1
gqJuvenileTotal = Juvenile Facilities Population Total: 2
gqNursingTotal = Nursing Facilities Population Total: 3
gqOtherInstTotal = Other Institutional Facilities Population Total: 4
noninstTotal = Noninstitutionalized Population Total: 5-7
gqCollegeTotal = College/University Student Housing Population Total: 5
gqMilitaryTotal = Military Quarters Housing Population Total: 6
gqOtherNoninstTotal = Other Noninstitutional Facilities Population Total: 7

[hhgq_ep HHGQ_EPAttr HHGQPersonSimpleAttr]
gqlevels = each 1-7

[hhgq_unit HHGQUnitDemoProductAttr]
levels = Occupied | Vacant | Federal detention centers | Federal prisons | State prisons | Local jails and other municipal confinement facilities | Correctional residential facilities | Military disciplinary barracks and jails | Group homes for juveniles (non-correctional) | Residential treatment centers for juveniles (non-correctional) | Correctional facilities intended for juveniles | Nursing facilities/skilled-nursing facilities | Mental (psychiatric) hospitals and psychiatric units in other hospitals | Hospitals with patients who have no usual home elsewhere | In-patient hospice facilities | Military treatment facilities with assigned patients | Residential schools for people with disabilities | College/university student housing | Military quarters | Military ships | Emergency and transitional shelters (with sleeping facilities) for people experiencing homelessness | Soup kitchens | Regularly scheduled mobile food vans | Targeted non-sheltered outdoor locations | Group homes intended for adults | Residential treatment centers for adults | Maritime/merchant vessels | Workers’ group living quarters and job corps centers | Living quarters for victims of natural disasters | Religious group quarters and domestic violence shelters
housing_units = Housing Units: 0-1
hhgq_vector = Housing Units: 0-1 | each 2-29
total_gq = Group Quarters: 2-29
gqlevels = each 2-29
vacant = Vacant: 1

[hhgq_unit_simple HHGQUnitSimpleAttr]
levels = Occupied | Vacant | Correctional GQ | Juvenile GQ | Nursing | Other Inst | College Dorm | Military | Other NonInst
housing_units = Housing Units: 0-1
hhgq_vector = Housing Units: 0-1 | each 2-8
total_gq = Group Quarters: 2-29
gqlevels = each 2-8
vacant = Vacant: 1

[hhgq_unit_simple_recoded HHGQUnitSimpleRecodedAttr]
levels = Housing Unit | Correctional GQ | Juvenile GQ | Nursing | Other Inst | College Dorm | Military | Other NonInst
housing_units = Housing Units: 0
hhgq_vector = each 0-7
total_gq = GQ: 1-7
hhgqSpineTypes = GQ 101-106 Correctional facilities for adults: 1 | GQ 201-203 Juvenile facilities: 2 | GQ 301 Nursing facilities/Skilled-nursing facilities: 3 | GQ 401-405 Other institutional facilities: 4 | GQ 501 College/University student housing: 5 | GQ 601-602 Military quarters: 6 | GQ 701-702, 704, 706, 801-802, 900-901, 903-904 Other noninstitutional facilities: 7
gqlevels = each 1-7

[hhgq_ep_unit HHGQEPUnitAttr HHGQUnitSimpleRecodedAttr]

[hisp HHHispAttr]
levels = Not Hispanic or Latino | Hispanic or Latino
hispTotal = Hispanic or Latino: 1
notHispTotal = Not Hispanic or Latino: 0

[hispanic HispAttr]
levels = Not Hispanic or Latino | Hispanic or Latino
hispTotal = Hispanic or Latino: 1
notHispTotal = Not Hispanic or Latino: 0

[hispanic1940 Hispanic1940Attr]
levels = Not Hispanic | Hispanic
hispTotal = Hispanic: 1
notHispTotal = Not Hispanic: 0

[multi HHMultiAttr]
levels = Household does not have three or more generations | Household has three or more generations
yes_multi = Yes, multigen: 1
no_multi = Not multigen: 0

[hhrace HHRaceAttr]
levels = white | black | aian | asian | nhopi | sor | two or more
whiteonly = White alone: 0

[race RaceAttr HHRaceAttr]
whitealone = White alone: 0
blackalone = Black alone: 1
aianalone = AIAN alone: 2
asianalone = Asian alone: 3
nhopialone = NHOPI alone: 4
soralone = Some other race alone: 5
tomr = Two or more races: 6

[cenrace1940 Race1940Attr]
levels = White | Black/African American | American Indian or Alaska Native | Chinese | Japanese | Other Asian or Pacific Islander

[cvaprace CVAPRace]
levels = Hispanic or Latino | White alone | Black or African American alone | American Indian and Alaska Native alone | Asian alone | Native Hawaiian and Other Pacific Islander alone | Some Other Race alone | Black or African American and White | American Indian and Alaska Native and White | Asian and White | American Indian and Alaska Native and Black or African American | Remainder of Two or More Race Responses

[hhsex HHSexAttr]
levels = Male | Female
male = male only: 0
female = female only: 1
sex_vect = Male: 0 | Female: 1

[sex SexAttr]
levels = Male | Female
male = Male: 0
female = Female: 1

[sex1940 Sex1940Attr SexAttr]

[size HHSizeAttr]
levels = 0-person household | 1-person household | 2-person household | 3-person household | 4-person household | 5-person household | 6-person household | 7-or-more-person household
size1 = 1-person household: 1
vacant = vacant household: 0
size2plus = 2-or-more-person household: 2-7
size2 = 2-person household: 2
size3 = 3-person household: 3
size4 = 4-person household: 4
sizex0 = each 1-7
sizex01 = each 2-7
solo = Alone: 1 | Not alone: 2-7

[hhtenshort HHTenShortAttr]
levels = Owned | Rented
tenure_2lev = Owned: 0 | Not owned: 1

[hhtenshort_3lev HHTenShort3LevAttr source=TEN]
levels = Owned with mortgage | Owned without mortgage | Rented
tenure_3lev = Owned with mortgage: 0 | Owned without mortgage: 1 | Not owned: 2
hhtenshort_2lev = Owned: 0-1 | Not owned: 2
hhtentotal = Total: 0-2

[tenure TenureAttr]
levels = Mortgage | Owned | Rented | No Pay
tenure_2lev = Owned: 0-1 | Not owned: 2-3

[ten2 Tenure2LevelAttr]
levels = Owned | Rented
tenure_2lev = Owned: 0 | Not owned: 1

[vacs VacancyAttr]
levels = Not vacant | {VACANT7}
vacant = Occupied: 0 | Vacant: 1-7

[tenvacgq TenureVacancyGQAttr source=TEN,VACS,GQTYPE]
levels = Mortgage | Owned | Rented | No Pay | {VACANT7} | {GQ24}
hhgqSpineTypes = GQ 101-106 Correctional facilities for adults: 11-16 | GQ 201-203 Juvenile facilities: 17-19 | GQ 301 Nursing facilities/Skilled-nursing facilities: 20 | GQ 401-405 Other institutional facilities: 21-25 | GQ 501 College/University student housing: 26 | GQ 601-602 Military quarters: 27-28 | GQ 701-702, 704, 706, 801-802, 900-901, 903-904 Other noninstitutional facilities: 29-34
vacant = Vacant: 4-10
vacantoccupied = Vacant: 4-10 | Occupied: 0-3,11-34
householdTotal = Households: 0-3
tenure_owned = Owned: 0-1
tenure_2lev = Owned: 0-1 | Not owned: 2-3
tenure_3lev = Owned with mortgage: 0 | Owned without mortgage: 1 | Not owned: 2-3
tenure = each 0-3
vacs = each 4-10
housing_units = Housing Units: 0-10
total_gq = Group Quarters: 11-34
hhgq_vector = Housing Units: 0-10 | each 11-34

[vacgq VacancyGQAttr]
levels = Household | {VACANT7} | {GQ24}
hhgqSpineTypes = GQ 101-106 Correctional facilities for adults: 8-13 | GQ 201-203 Juvenile facilities: 14-16 | GQ 301 Nursing facilities/Skilled-nursing facilities: 17 | GQ 401-405 Other institutional facilities: 18-22 | GQ 501 College/University student housing: 23 | GQ 601-602 Military quarters: 24-25 | GQ 701-702, 704, 706, 801-802, 900-901, 903-904 Other noninstitutional facilities: 26-31
vacant = Household-or-GQ: 0,8-31 | Vacant: 1-7
householdTotal = Households: 0
vacs = each 1-7 | Household-or-GQ: 0,8-31
housing_units = Housing Units: 0-7
total_gq = Group Quarters: 8-31
hhgq_vector = Housing Units: 0-7 | each 8-31

[votingage VotingAgeAttr]
levels = 17 and under | 18 and over
voting = 18 and over: 1
nonvoting = 17 and under: 0

[hhtype HHTypeAttr]
levels = Married opposite-sex with own children under 18, under 6 yrs only | Married opposite-sex with own children under 18, between 6 and 17 only | Married opposite-sex with own children under 18, both ranges | Married opposite-sex no own children under 18 | Married same-sex with own children only under 6 yrs | Married same-sex with own children between 6 and 17 | Married same-sex with own children in both ranges | Married same-sex no own children under 18 | Cohabiting opposite-sex with own children only under 6 yrs | Cohabiting opposite-sex with own children between 6 and 17 | Cohabiting opposite-sex with own children in both ranges | Cohabiting opposite-sex with relatives, no own children under 18 | Cohabiting opposite-sex without relatives, no own children under 18 | Cohabiting same-sex with own children only under 6 yrs | Cohabiting same-sex with own children between 6 and 17 | Cohabiting same-sex with own children in both ranges | Cohabiting same-sex with relatives, no own children under 18 | Cohabiting same-sex without relatives, no own children under 18 | No spouse or partner, alone | No spouse or partner with own children under 6 | No spouse or partner with own children between 6 and 17. | No spouse or partner with own children in both ranges | No spouse or partner living with relatives but no own children | No spouse or partner and no relatives, not alone.
ownchild_under6 = Householder has own child under 6: 0,2,4,6,8,10,13,15,19,21
ownchild_under18 = Householder has own child under 18: 0-2,4-6,8-10,13-15,19-21
family = Family: 0-11,13-16,19-22
nonfamily = Non-Family: 12,17,18,23
marriedfamily = Married Family: 0-7
otherfamily = Other Family: 8-11,13-16,19-22
alone = Alone: 18
invert_alone = Not alone: 0-17,19-23
notalone = Nonfamily, Not alone: 12,17,23
non2type = Types inconsistent with size 2: 0-2,4-6,8-11,13-16,18,21
type2_onechild = Size 2, householder with child: 19-20
type2_couple = Size 2, householder with spouse/unmarried partner: 3,7,12,17
non3type = Type not consistent with size 3: 2,6,10,15,18
type3_notmulti = Size 3, can't be multi: 0,1,3-5,7-9,11-14,16,17,21,23
type3_twochild = Size 3, two children: 21
type3_couple_with_child = Size 3, couple with one child: 0,1,4,5,8,9,13,14
type4_notmulti = Size 4, can't be multigen: 2,6,10,12,15,17,23
type4_couple_with_twochildren = Size 4, couple with two children: 2,6,10,15
never_multi = Can never be multigen regardless of size: 12,17,18,23
married_with_children_indicator = Married without own children under 18: 3,7 | Married with own children under 18: 0-2,4-6
other_with_children_indicator = Other family without own children under 18: 11,16 | Other family with own children under 18: 8-10,13-15
cohabiting = Cohabiting: 8-17
cohabiting_with_children_indicator = Cohabiting without own children under 18: 11,12,16,17 | Cohabiting with own children under 18: 8-10,13-15
no_spouse_or_partner = No spouse or partner: 18-23
no_spouse_or_partner_levels = Alone: 18 | With own children: 19-21 | With relatives, no own children: 22 | No relatives, not alone: 23
married_with_children_levels = Married with children under 6 only: 0,4 | Married with children 6 to 17 years only: 1,5 | Married with children under 6 years and 6 to 17 years: 2,6
other_with_children_levels = Other family with children under 6 only: 8,13,19 | Other family with children 6 to 17 years only: 9,14,20 | Other family with children under 6 years and 6 to 17 years: 10,15,21
couplelevels = Married: 0-7 | Unmarried Partner: 8-17 | All others: 18-23
oppositelevels = Married Opposite: 0-3 | Partner Opposite: 8-12
samelevels = Married Same: 4-7 | Partner Same: 13-17

[rel RelAttr]
levels = Householder | Husband/Wife | Biological Son/Daughter | Adopted Son/Daughter | Stepson/Stepdaughter | Brother/Sister | Father/Mother | Grandchild | Parent-in-law | Son/Daughter-in-law | Other relative | Roomer, Boarder | Housemate, Roommate | Unmarried Partner | Other Non-relative | Federal Detention Centers (101) | Federal Prisons (102) | State Prisons (103) | Local Jails and Other Municipal Confinement Facilities (104) | Correctional Residential Facilities (105) | Military Disciplinary Barracks and Jails (106) | Group Homes for Juveniles (Non-Correctional) (201) | Residential Treatment Centers (Non-Correctional) (202) | Correctional Facilities Intended for Juveniles (203) | Nursing Facilities/Skilled-Nursing Facilities (301) | Mental (Psychiatric) Hospitals and Psychiatric Units in Other Hospitals (401) | Hospitals with Patients Who Have No Usual Home Elsewhere (402) | In-Patient Hospice Facilities (403) | Military Treatment Facilities with Assigned Patients (404) | Residential Schools for People with Disabilities (405) | College/University Student Housing (501) | Military Quarters (601) | Military Ships (602) | Emergency and Transitional Shelters (with Sleeping Facilities) for People Experiencing Homelessness (701) | Soup Kitchens (702) | Regularly Scheduled Mobile Food Vans (704) | Targeted Non-Sheltered Outdoor Locations (706) | Group Homes Intended for Adults (801) | Residential Treatment Centers for Adults (802) | Maritime/Merchant Vessels (900) | Workers' Group Living Quarters and Job Corps Centers (901) | Living Quarters for Victims of Natural Disasters (903) | Religious Group Quarters and Domestic Violence Shelters (904)
gqlevels = Household: 0-14 | each 15-42
rel_cantbekids = Cannot be younger than 15: 0,1,6,8,9,12,13
rel_parents = Parent: 6,8
rel_children = Child: 2-4,9

[relgq RelGQAttr]
levels = Householder living alone | Householder not living alone | Opposite-sex spouse | Opposite-sex unmarried partner | Same-sex spouse (Use allocation flag to determine) | Same-sex unmarried partner | Biological son or daughter | Adopted son or daughter | Stepson or stepdaughter | Brother or sister | Father or mother | Grandchild | Parent-in-law | Son-in-law or daughter-in-law | Other relative | Roommate or housemate | Foster child (If roomer/boarder and age<21) | Other nonrelative (also include if roomer/boarder and age>=21) | {GQ24}
gqlevels = Household: 0-17 | each 18-41
relgq_pst1 = each 18-41
relgq_dhcp_P15_1 = Correctional facilities for adults (101-106): 18-23 | Juvenile facilities (201-203): 24-26 | Nursing facilities/Skilled-nursing facilities (301): 27 | Other institutional facilities (401-405): 28-32 | College/University student housing (501): 33 | Military quarters (601-602): 34-35 | Other noninstitutional facilities (701-702, 704, 706, 801-802, 900-901, 903-904): 36-41
relgq_4_groups = Householder: 0-1 | Non-Householder: 2-17 | Institutionalized population: 18-32 | Noninstitutionalized population: 33-41
gq_constr_groups = In a household: 0-17 | In a GQ that enters into DHCP AGE * RELGQ invariant constraint for AGE < 3: 32 | In a GQ that enters into DHCP AGE * RELGQ invariant constraint for AGE < 15: 18-22 | In a GQ that enters into DHCP AGE * RELGQ invariant constraint for AGE < 16: 33,37-41 | In a GQ that enters into DHCP AGE * RELGQ invariant constraint for AGE < 17: 23,31,34,35 | In a GQ that does not enter into DHCP AGE * RELGQ invariant constraint for AGE < 18: 24-30,36
popSehsdTargetsRelship = each 0-17 | In a GQ: 18-41
relship_and_eight_level_GQ = each 0-17 | Correctional facilities for adults: 18-23 | Juvenile facilities: 24-26 | Nursing facilities/Skilled-nursing facilities: 27 | Other institutional facilities: 28-32 | College/University student housing: 33 | Military quarters: 34-35 | Other noninstitutional facilities: 36-41
householders = Householders living alone or not alone: 0-1
hhgq8lev = HOUSEHOLD: 0-17 | Correctional facilities for adults: 18-23 | Juvenile facilities: 24-26 | Nursing facilities/Skilled-nursing facilities: 27 | Other institutional facilities: 28-32 | College/University student housing: 33 | Military quarters: 34-35 | Other noninstitutional facilities: 36-41
gq_ep = Correctional facilities for adults: 18-22 | Juvenile facilities: 24-26 | Nursing facilities/Skilled-nursing facilities: 27 | Other institutional facilities: 28-30,32 | College/University student housing: 33 | Military quarters: 23,31,34,35 | Other noninstitutional facilities: 36-41
hhgq_ep = HOUSEHOLD: 0-17 | Correctional facilities for adults: 18-22 | Juvenile facilities: 24-26 | Nursing facilities/Skilled-nursing facilities: 27 | Other institutional facilities: 28-30,32 | College/University student housing: 33 | Military quarters: 23,31,34,35 | Other noninstitutional facilities: 36-41
hhinstlevels = Household: 0-17 | Institutional Facility: 18-32 | Non-Institutional Facility: 33-41
spouses_unmarried_partners = Spouses & Unmarried Partners: 2-5
people_in_households = People in Households: 0-17
hhspchildothgq = Householder, spouse, or unmarried partner: 0-5 | Own Child: 6-8 | Other Children: 9-17 | In Group Quarters: 18-41
relgq8cats = Householder living alone: 0 | Householder not living alone: 1 | Spouse or partner: 2-5 | Parent or parent-in-law: 10,12 | Other relatives: 14 | Other nonrelatives: 15,17 | In Group Quarters: 18-41

[cenrace CenraceAttr]
majorRaces = White alone: 0 | Black or African American alone: 1 | American Indian and Alaska Native alone: 2 | Asian alone: 3 | Native Hawaiian and Other Pacific Islander alone: 4 | Some Other Race alone: 5 | Two or More Races: 6-62
cenrace11cats = White alone: 0 | Black or African American alone: 1 | American Indian and Alaska Native alone: 2 | Asian alone: 3 | Native Hawaiian and Other Pacific Islander alone: 4 | Some Other Race alone: 5 | Black or African American and White: 6 | American Indian and Alaska Native and White: 7 | Asian and White: 8 | American Indian and Alaska Native and Black or African American: 11 | Balance/remainder: 9,10,12-62
whiteAlone = White alone: 0
blackAlone = Black or African American alone: 1
aianAlone = American Indian and Alaska Native alone: 2
asianAlone = Asian alone: 3
nhopiAlone = Native Hawaiian and Pacific Islander alone: 4
sorAlone = Some Other Race alone: 5
tomr = Two or more races: 6-62
race7lev = white: 0 | black: 1 | aian: 2 | asian: 3 | nhopi: 4 | sor: 5 | Two or more races: 6-62
cenrace_7lev_two_comb = white: 0 | black: 1,6 | aian: 2,7 | asian: 3,8 | nhopi: 4,9 | sor: 5,10 | Two or more races: 11-62
allraces = white: 0 | black: 1 | aian: 2 | asian: 3 | nhopi: 4 | sor: 5
"""

GQ24 = """GQ 101 Federal detention centers | GQ 102 Federal prisons | GQ 103 State prisons | GQ 104 Local jails and other municipal confinements | GQ 105 Correctional residential facilities | GQ 106 Military disciplinary barracks | GQ 201 Group homes for juveniles | GQ 202 Residential treatment centers for juveniles | GQ 203 Correctional facilities intended for juveniles | GQ 301 Nursing facilities | GQ 401 Mental hospitals | GQ 402 Hospitals with patients who have no usual home elsewhere | GQ 403 In-patient hospice facilities | GQ 404 Military treatment facilities | GQ 405 Residential schools for people with disabilities | GQ 501 College/university student housing | GQ 601 Military quarters | GQ 602 Military ships | GQ 701 Emergency and transitional shelters | GQ 801 Group homes intended for adults | GQ 802 Residential treatment centers for adults | GQ 900 Maritime/merchant vessels | GQ 901 Workers' group living quarters and job corps centers | GQ 997 Other noninstitutional (GQ types 702, 704, 706, 903, 904)"""
VACANT7 = "Vacant, for rent | Vacant, rented, not occupied | Vacant, for sale only Pay | Vacant, sold, not occupied | Vacant, for seasonal, recreational, or occasional use | Vacant, for migrant workers | Vacant, other"
RACES = ("white", "black", "aian", "asian", "nhopi", "sor")
RACE_NAMES = (
    "White", "Black or African American", "American Indian and Alaska Native", "Asian",
    "Native Hawaiian and Other Pacific Islander", "Some Other Race",
)
RACE_SHORT = ("White", "Black", "Aian", "Asian", "Nhopi", "Some other race")
# Facility codes of the unit tables by level; the codes without a level of their own fall to the last one
GQ_CODES = "101 102 103 104 105 106 201 202 203 301 401 402 403 404 405 501 601 602 701 801 802 900 901 997"
GQ_CODES_TO_LAST = "702 704 706 903 904"

# Age groupings: lower bounds of the groups, then the label of the last group
AGE_BANDS = """
agecat43 = 0 18 65 | 65 years and over
age_26_groups = 0 5 10 15 18 20 25 30 35 40 45 50 55 60 62 65 67 70 75 80 85 90 95 100 105 110 | 110 to 115 years
age_29_groups = 0 3 5 10 15 16 17 18 20 25 30 35 40 45 50 55 60 62 65 67 70 75 80 85 90 95 100 105 110 | 110 to 115 years
age_38_groups = 0 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 18 20 25 30 35 40 45 50 55 60 62 65 67 70 75 80 85 90 95 100 105 110 | 110 to 115 years
age_40_groups = 0 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 20 25 30 35 40 45 50 55 60 62 65 67 70 75 80 85 90 95 100 105 110 | 110 to 115 years
age_10_groups = 0 3 15 16 17 18 20 25 30 35 | 35 to 115 years
agegroup64 = 0 64 | 64 to 115 years
agecatPCO3 = 0 20 25 30 35 40 45 50 55 60 65 70 75 80 85 | 85 years and over
agecatPCO4 = 0 5 10 15 20 25 | 25 years and over
agePyramid23groups = 0 5 10 15 18 20 21 22 25 30 35 40 45 50 55 60 62 65 67 70 75 80 85 | 85 and over
"""
AGE_EP_BANDS = """
agecat43 = 0 18 65 | 65 years and over
age_26_groups = 0 5 10 15 18 20 25 30 35 40 45 50 55 60 62 65 67 70 75 80 85 90 95 100 | 100+ years
age_23_groups = 0 1 5 10 15 18 20 25 30 35 40 45 50 55 60 65 70 75 80 85 90 95 100 | 100+ years
age_29_groups = 0 3 5 10 15 16 17 18 20 25 30 35 40 45 50 55 60 62 65 67 70 75 80 85 90 95 100 | 100+ years
age_36_groups = 0 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 18 20 25 30 35 40 45 50 55 60 62 65 67 70 75 80 85 90 95 100 | 100+ years
age_38_groups_ep = 0 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 20 25 30 35 40 45 50 55 60 62 65 67 70 75 80 85 90 95 100 | 100+ years
age_10_groups = 0 3 15 16 17 18 20 25 30 35 | 35+ years
agegroup64 = 0 64 | 64+ years
agecatPCO3 = 0 20 25 30 35 40 45 50 55 60 65 70 75 80 85 | 85 years and over
agecatPCO4 = 0 5 10 15 20 25 | 25 years and over
agePyramid23groups = 0 5 10 15 18 20 21 22 25 30 35 40 45 50 55 60 62 65 67 70 75 80 85 | 85 and over
"""
# Age groupings that are subsets or unions; 'top' stands for the highest level
AGE_GROUPS = """
votingage = Non-voting Age: 0-17 | Voting Age: 18-top
nonvoting = Non-voting Age: 0-17
voting = Voting Age: 18-top
age_lessthan15 = Age is <15: 0-14
age_lessthan20 = Age is <20: 0-19
age_lessthan30 = Age is <30: 0-29
age_greaterthan25 = Age is >25: 26-top
age_greaterthan89 = Age is >89: 90-top
age_lt17gt65 = Age is <17 or >65: 0-16,66-top
age_lt16gt65 = Age is <16 or >65 : 0-15,66-top
age_gt74 = Age is >74: 75-top
age_lt15_gt89 = Age is <15 or >89: 0-14,90-top
age_lt3_gt30 = Age is <3 or >30: 0-2,31-top
age_lt16 = Age is <16: 0-15
age_gt20 = Age is >20: 21-top
age_lt16_gt75 = Age is <16 or >75: 0-15,76-top
agePopEst18groups = Under 5 years: 0-5 | 5 to 9 years: 5-9 | 10 to 14 years: 10-14 | 15 to 19 years: 15-19 | 20 to 24 years: 20-24 | 25 to 29 years: 25-29 | 30 to 34 years: 30-34 | 35 to 39 years: 35-39 | 40 to 44 years: 40-44 | 45 to 49 years: 45-49 | 50 to 54 years: 50-54 | 55 to 59 years: 55-59 | 60 to 64 years: 60-64 | 65 to 69 years: 65-69 | 70 to 74 years: 70-74 | 75 to 79 years: 75-79 | 80 to 84 years: 80-84 | 85 and over: 85-top
agePopEst3groups = 5 to 13 years: 5-13 | 14 to 17 years: 14-17 | 18 to 24 years: 18-24
agePopEst2groups = under 18 years: 0-17 | 18 to 64 years: 18-64
agePopEst16plus = age 16 and over: 16-top
age_18_64_116 = under 18 years: 0-17 | 18 to 64 years: 18-64 | 65 and over: 65-top
age18plus = 18 and over: 18-top
age_dhcp_P14_3 = under 18 years: 0-17 | 18 and over: 18-top
age_only_100_plus = 100 years and over: 100-top
childage7lev = Under 3 years: 0-2 | 3 and 4 years: 3-4 | 5 years: 5 | 6 to 11 years: 6-11 | 12 and 13 years: 12-13 | 14 years: 14 | 15 to 17 years: 15-17
65andover = 65 years and over: 65-top
"""
BINARY_SPLITS = (116, 58, 29, 15, 7, 4, 2, 1)

# Household types: predicates over the indicator columns built in household_types()
HOUSEHOLD_RECODES = """
multig = Not a Multi-generational Household: MULTIG == 0 | Multi-generational Household: MULTIG == 1
partner_type_own_child_status = Married with own children under 18: MARRIED == 1 and OWN_CHILD_UNDER_18 == 1 | Married without own children under 18: MARRIED == 1 and OWN_CHILD_UNDER_18 == 0 | Cohabiting with own children under 18: COHABITING == 1 and OWN_CHILD_UNDER_18 == 1 | Cohabiting without own children under 18: COHABITING == 1 and OWN_CHILD_UNDER_18 == 0 | No spouse/partner, with own children under 18: NO_SPOUSE_OR_PARTNER == 1 and OWN_CHILD_UNDER_18 == 1 | No spouse/partner, without own children under 18: NO_SPOUSE_OR_PARTNER == 1 and OWN_CHILD_UNDER_18 == 0
coupled_hh_type = Married Same Sex: MARRIED_SAME_SEX == 1 | Married Opposite Sex: MARRIED_OPPOSITE_SEX == 1 | Unmarried Same Sex: COHABITING_SAME_SEX == 1 | Unmarried Opposite Sex: COHABITING_OPPOSITE_SEX == 1 | No spouse/partner: NO_SPOUSE_OR_PARTNER == 1
family_nonfamily_size = Family, Size=2: WITH_RELATIVES == 1 and SIZE == 2 | Family, Size=3: WITH_RELATIVES == 1 and SIZE == 3 | Family, Size=4: WITH_RELATIVES == 1 and SIZE == 4 | Family, Size=5: WITH_RELATIVES == 1 and SIZE == 5 | Family, Size=6: WITH_RELATIVES == 1 and SIZE == 6 | Family, Size=7+: WITH_RELATIVES == 1 and SIZE == 7 | Non-Family, Size=1: WITH_RELATIVES == 0 and SIZE == 1 | Non-Family, Size=2: WITH_RELATIVES == 0 and SIZE == 2 | Non-Family, Size=3: WITH_RELATIVES == 0 and SIZE == 3 | Non-Family, Size=4: WITH_RELATIVES == 0 and SIZE == 4 | Non-Family, Size=5: WITH_RELATIVES == 0 and SIZE == 5 | Non-Family, Size=6: WITH_RELATIVES == 0 and SIZE == 6 | Non-Family, Size=7+: WITH_RELATIVES == 0 and SIZE == 7
hhsize_all = 1-person household: SIZE == 1 | 2-person household: SIZE == 2 | 3-person household: SIZE == 3 | 4-person household: SIZE == 4 | 5-person household: SIZE == 5 | 6-person household: SIZE == 6 | 7+-person household: SIZE == 7
dhch_hhtype_p12_part1 = Married Couple HH with Own Children <18: MARRIED == 1 and OWN_CHILD_UNDER_18 == 1 | Married Couple HH W/o Own Children <18: MARRIED == 1 and OWN_CHILD_UNDER_18 == 0 | Cohabiting Couple HH with Own Children <18: COHABITING == 1 and OWN_CHILD_UNDER_18 == 1 | Cohabiting Couple HH W/o Own Children <18: COHABITING == 1 and OWN_CHILD_UNDER_18 == 0
dhch_hhtype_p12_part2 = No Spouse/Partner, W/ Own Children under 18: NO_SPOUSE_OR_PARTNER == 1 and OWN_CHILD_UNDER_18 == 1 | No Spouse/Partner, W/ Relatives, W/o Own Children under 18: NO_SPOUSE_OR_PARTNER == 1 and OWN_CHILD_UNDER_18 == 0 and WITH_RELATIVES == 1 | No Spouse/Partner, Not Alone, Only non-relatives present: NO_SPOUSE_OR_PARTNER == 1 and WITH_RELATIVES == 0 and NOT_ALONE == 1
dhch_hhtype_p12_part3 = Alone: NOT_ALONE == 0
dhch_pco3_margin2 = Other family (not married couple): MARRIED == 0 and WITH_RELATIVES == 1
dhch_p16_margin = Households with one or more people under 18:: CHILD_UNDER_18 == 1 | Households with no people under 18:: CHILD_UNDER_18 == 0
size1_size2plus = Size 1: SIZE == 1 | Size 2+: SIZE >= 2
dhch_pco3_margin1 = Married Couple Family: MARRIED == 1 | Other Family (Unmarried/No Spouse): MARRIED == 0 and WITH_RELATIVES == 1
dhch_pco3_margin3 = Family Households: WITH_RELATIVES == 1 | Non-Family Households (2+/not alone): NOT_ALONE == 1 and WITH_RELATIVES == 0
dhch_hhtype_hct3 = With children under 6 only: CHILD_UNDER_6_ONLY_EXCLUDING_HOUSEHOLDER_SPOUSE_PARTNER == 1 | With children 6-17 only: CHILD_BETWEEN_6_AND_17_EXCLUDING_HOUSEHOLDER_PARTNER == 1 | With children under 6 and 6-17: CHILD_IN_BOTH_RANGES_EXCLUDING_HOUSEHOLDER_PARTNER == 1 | No children under 18: CHILD_UNDER_18_EXCLUDING_HOUSEHOLDER_SPOUSE_PARTNER == 0
hhtype_dhch_married_fam_pco11_p1 = Married with no own children under 18 years: MARRIED == 1 and OWN_CHILD_UNDER_18 == 0 | Married with own children under 6 only: MARRIED == 1 and OWN_CHILD_UNDER_6_ONLY == 1 | Married with own children 6 to 17 years only: MARRIED == 1 and OWN_CHILD_BETWEEN_6_AND_17 == 1 | Married with own children under 6 years and 6 to 17 years: MARRIED == 1 and OWN_CHILD_IN_BOTH_RANGES == 1
popSehsdTarget_upart = Same-sex Partner: MARRIED_SAME_SEX == 1 or COHABITING_SAME_SEX == 1 | Opposite-sex Partner: MARRIED_OPPOSITE_SEX == 1 or COHABITING_OPPOSITE_SEX == 1 | No partner: NO_SPOUSE_OR_PARTNER == 1
size1 = 1-person household: SIZE == 1
size2 = 2-person household: SIZE == 2
family = Family: MARRIED != 0 or OWN_CHILD_UNDER_18 != 0 or WITH_RELATIVES != 0
nonfamily = Non-Family: MARRIED == 0 and OWN_CHILD_UNDER_18 == 0 and WITH_RELATIVES == 0
marriedfamily = Married Family: MARRIED != 0
married_with_children_indicator = Married with own children under 18: MARRIED != 0 and OWN_CHILD_UNDER_18 != 0 | Married without own children under 18: MARRIED != 0 and OWN_CHILD_UNDER_18 == 0
married_with_children_levels = Married with children under 6 only: MARRIED != 0 and OWN_CHILD_UNDER_6_ONLY != 0 | Married with children 6 to 17 years only: MARRIED != 0 and OWN_CHILD_BETWEEN_6_AND_17 != 0 | Married with children under 6 years and 6 to 17 years: MARRIED != 0 and OWN_CHILD_IN_BOTH_RANGES != 0
otherfamily = Other Family: MARRIED == 0 and (OWN_CHILD_UNDER_18 != 0 or WITH_RELATIVES != 0)
other_with_children_indicator = Other with own children under 18: MARRIED == 0 and OWN_CHILD_UNDER_18 != 0 | Other without own children under 18: MARRIED == 0 and OWN_CHILD_UNDER_18 == 0
other_with_children_levels = Other with children under 6 only: MARRIED == 0 and OWN_CHILD_UNDER_6_ONLY != 0 | Other with children 6 to 17 years only: MARRIED == 0 and OWN_CHILD_BETWEEN_6_AND_17 != 0 | Other with children under 6 years and 6 to 17 years: MARRIED == 0 and OWN_CHILD_IN_BOTH_RANGES != 0
alone = Alone: NOT_ALONE == 0
invert_alone = Not alone: NOT_ALONE != 0
notalone = Non-Family not alone: NOT_ALONE != 0 and MARRIED == 0 and OWN_CHILD_UNDER_18 == 0 and WITH_RELATIVES == 0
non2type = Not size two: SIZE != 2
child_alone = Child alone: SIZE == 1 and CHILD_UNDER_18 == 1
type2_onechild = Size two with child: SIZE == 2 and (OWN_CHILD_UNDER_18 != 0 or CHILD_UNDER_18_EXCLUDING_HOUSEHOLDER_SPOUSE_PARTNER != 0 or CHILD_UNDER_18 != 0)
type2_onechildxhh = Size two with child: SIZE == 2 and (OWN_CHILD_UNDER_18 != 0 or CHILD_UNDER_18_EXCLUDING_HOUSEHOLDER_SPOUSE_PARTNER != 0)
type2_couple = Size 2, householder with spouse/unmarried partner: SIZE == 2 and (MARRIED != 0 or COHABITING != 0)
ownchild_under6 = Householder has own child under 6: OWN_CHILD_UNDER_6_ONLY != 0 or OWN_CHILD_IN_BOTH_RANGES != 0
ownchild_under18 = Householder has own child under 18: OWN_CHILD_UNDER_18 != 0
type3_twochild = Size 3, two children: SIZE == 3 and OWN_CHILD_IN_BOTH_RANGES != 0
type3_couple_with_child = Size 3, couple with one child: NO_SPOUSE_OR_PARTNER == 0 and SIZE == 3 and OWN_CHILD_UNDER_18 != 0
type4_couple_with_twochildren = Size 4, couple with two children: SIZE == 4 and OWN_CHILD_IN_BOTH_RANGES != 0 and NO_SPOUSE_OR_PARTNER == 0
other_with_children_indicator_2 = Other with own children under 18: MARRIED == 0 and OWN_CHILD_UNDER_18 != 0 | Other without own children under 18: MARRIED == 0 and OWN_CHILD_UNDER_18 == 0 and WITH_RELATIVES == 1
"""
# Crosses of predicates, empty combinations left out: recode = list x list x ...
HOUSEHOLD_CROSSES = {
    "partner_type_detailed_own_child_status": ("NO_SPOUSE_OR_PARTNER==1 MARRIED==1 COHABITING==1", "OWN_CHILD_UNDER_6_ONLY==1 NO_OWN_CHILD_UNDER_18==1 OWN_CHILD_BETWEEN_6_AND_17==1 OWN_CHILD_IN_BOTH_RANGES==1"),
    "DetailedCoupleTypeMultGenOwnChildSize": ("COUPLE", "MULTIG==0 MULTIG==1", "OWN_CHILD_UNDER_18==0 OWN_CHILD_UNDER_18==1", "SIZES"),
    "DetailedCoupleTypeMultGenDetOwnChildSize": ("COUPLE", "MULTIG==0 MULTIG==1", "OWN", "SIZES"),
    "DetailedCoupleTypeDetOwnChildSize": ("COUPLE", "OWN", "SIZES"),
}
HOUSEHOLD_LISTS = {
    "COUPLE": "NO_SPOUSE_OR_PARTNER==1 MARRIED_SAME_SEX==1 MARRIED_OPPOSITE_SEX==1 COHABITING_SAME_SEX==1 COHABITING_OPPOSITE_SEX==1",
    "OWN": "OWN_CHILD_UNDER_18==0 OWN_CHILD_UNDER_6_ONLY==1 OWN_CHILD_BETWEEN_6_AND_17==1 OWN_CHILD_IN_BOTH_RANGES==1",
    "SIZES": "SIZE==1 SIZE==2 SIZE==3 SIZE==4 SIZE==5 SIZE==6 SIZE==7",
}

# ---- reading the text -----------------------------------------------------------------------


@dataclass
class Attribute:
    name: str
    cls: str
    levels: list[str] = field(default_factory=list)
    recodes: dict[str, list[tuple[str, list[int]]]] = field(default_factory=dict)
    source: tuple[str, ...] = ()

    @property
    def size(self) -> int:
        return len(self.levels)


def _numbers(text: str, top: int) -> list[int]:
    out: list[int] = []
    for part in text.split(","):
        lo, _, hi = part.strip().replace("top", str(top)).partition("-")
        out += range(int(lo), int(hi or lo) + 1)
    return out


def _groups(text: str, labels: list[str]) -> list[tuple[str, list[int]]]:
    out = []
    for part in text.split(" | "):
        if part.startswith("each "):
            out += [(labels[i], [i]) for i in _numbers(part[5:], len(labels) - 1)]
        else:
            label, levels = part.rsplit(": ", 1)
            out.append((label, _numbers(levels, len(labels) - 1)))
    return out


def _lines(text: str):
    for line in text.strip().splitlines():
        if line.strip():
            name, _, body = line.partition(" = ")
            yield name.strip(), body.strip("\n")


def _read() -> dict[str, Attribute]:
    found: dict[str, Attribute] = {}
    now = None
    for line in TEXT.strip().splitlines():
        if line.startswith("["):
            words = line.strip("[]").split()
            now = Attribute(words[0], words[1])
            for w in words[2:]:
                if w.startswith("source="):
                    now.source = tuple(w[7:].split(","))
                else:
                    now.levels = list(found[w].levels)
                    now.recodes = dict(found[w].recodes)
            found[now.cls] = now
            if now.cls == "CenraceAttr":
                now.levels = ["-".join(c) for c in race_combinations(RACES)]
        elif " = " in line:
            name, _, body = line.partition(" = ")
            body = body.replace("{GQ24}", GQ24).replace("{VACANT7}", VACANT7)
            if name == "levels":
                now.levels = body.split(" | ")
            elif body.startswith("same "):
                now.recodes[name] = now.recodes[body[5:]]
            else:
                now.recodes[name] = _groups(body, now.levels)
    return found


# ---- rules ----------------------------------------------------------------------------------


def race_combinations(races) -> list[tuple[str, ...]]:
    """All non-empty combinations: fewer races first, then in the order of the list."""
    return [c for k in range(1, len(races) + 1) for c in combinations(races, k)]


def _race_recodes(a: Attribute) -> None:
    sets = [set(x.split("-")) for x in a.levels]
    sizes = range(1, len(RACES) + 1)
    a.recodes["numraces"] = [
        (f"{k} Race" if k == 1 else f"{k} Races", [i for i, s in enumerate(sets) if len(s) == k]) for k in sizes
    ]
    having = {r: [i for i, s in enumerate(sets) if r in s] for r in RACES}
    a.recodes["racecomb"] = [
        (f"{n} alone or in combination with one or more other races", having[r]) for r, n in zip(RACES, RACE_NAMES)
    ]
    short = [(f"{n} alone or in combination", having[r]) for r, n in zip(RACES, RACE_SHORT)]
    a.recodes["racecombos"] = short
    for r, g in zip(RACES, short):
        a.recodes[f"{r}combo"] = [g]


def _year(i: int) -> str:
    return "Under 1 year" if i == 0 else "1 year" if i == 1 else f"{i} years"


def _band(lo: int, hi: int) -> str:
    if hi == lo + 1:
        return _year(lo)
    return f"Under {hi} years" if lo == 0 else f"{lo} to {hi - 1} years"


def _bands(text: str, size: int) -> list[tuple[str, list[int]]]:
    starts, last = text.split(" | ")
    cuts = [int(x) for x in starts.split()] + [size]
    out = [(_band(a, b), list(range(a, b))) for a, b in zip(cuts, cuts[1:])]
    out[-1] = (last, out[-1][1])
    return out


def _every(width: int, size: int, last: str | None) -> list[tuple[str, list[int]]]:
    out = [(_band(a, min(a + width, size)), list(range(a, min(a + width, size)))) for a in range(0, size, width)]
    if last:
        out[-1] = (last, out[-1][1])
    return out


def _age(name: str, cls: str, size: int) -> Attribute:
    ep = size == 101
    a = Attribute(name, cls, [_year(i) for i in range(size)])
    if ep:
        a.levels[100] = "100+ years"
    every = lambda hi: [(a.levels[i], [i]) for i in range(hi)]
    top = list(range(100, size))
    for k, v in _lines(AGE_EP_BANDS if ep else AGE_BANDS):
        a.recodes[k] = _bands(v, size)
    for k, v in _lines(AGE_GROUPS):
        a.recodes[k] = _groups(v, a.levels)
    a.recodes["agegroup4"] = _every(4, size, "100+ years" if ep else None)
    a.recodes["agegroup16"] = _every(16, size, "96+ years" if ep else None)
    a.recodes["prefix_agecats"] = [(f"age 0-{j}" if j else "age 0", list(range(j + 1))) for j in range(size)]
    a.recodes["range_agecats"] = [
        (f"age {k}" if j == k else f"age {k}-{j}", list(range(k, j + 1))) for j in range(size) for k in range(j + 1)
    ]
    a.recodes["ageupto100"] = every(100) + [("Over 100", top)]
    a.recodes["agecat85plus"] = every(85) + [("85 years and over", list(range(85, size)))]
    a.recodes["agecat100plus"] = every(100) + [("100+ years" if ep else "100 years and over", top)]
    if ep:
        a.recodes["agepct12"] = every(100) + [("100+ years", top)]
    else:
        a.recodes["age_ep"] = [(f"{i} years", [i]) for i in range(100)] + [("100+ years", top)]
        a.recodes["agepct12"] = every(100) + [
            ("100 to 104 years", list(range(100, 105))), ("105 to 109 years", list(range(105, 110))),
            ("110 years and over", list(range(110, size))),
        ]
        split = []
        for w in BINARY_SPLITS:
            start = 0
            while start < size - 1:  # a last single year is left out, as published
                ages = list(range(start, min(start + w, size)))
                span = f"{start}" if len(ages) == 1 else f"{start}-{ages[-1]}"
                split.append((f"split{w}: age {span}", ages))
                start = ages[-1] + 1
        a.recodes["binarysplit_agecats"] = split
    return a


def household_types() -> list[dict[str, int]]:
    """The 522 possible household types as indicator rows, in level order.

    A household is possible when its size leaves room for the householder, the
    partner, one child per age range present, and the third generation. Only
    relatives make generations, and a householder under 18 heads none.
    """
    child = ("u6", "6to17", "both", "none")
    couples = ("married opposite", "married same", "cohabiting opposite", "cohabiting same", "single")
    out = []

    def add(couple, related, own, kids, minor, multig, size):
        married, cohabiting = couple.startswith("married"), couple.startswith("cohab")
        row = {
            "NO_SPOUSE_OR_PARTNER": couple == "single", "NOT_ALONE": size > 1,
            "COHABITING_SAME_SEX": couple == "cohabiting same", "COHABITING_OPPOSITE_SEX": couple == "cohabiting opposite",
            "MARRIED_SAME_SEX": couple == "married same", "MARRIED_OPPOSITE_SEX": couple == "married opposite",
            "NO_RELATIVES": not related, "WITH_RELATIVES": related,
            "NO_OWN_CHILD_UNDER_18": own == "none", "OWN_CHILD_UNDER_18": own != "none", "OWN_CHILD_IN_BOTH_RANGES": own == "both",
            "OWN_CHILD_BETWEEN_6_AND_17": own == "6to17", "OWN_CHILD_UNDER_6_ONLY": own == "u6",
            "NO_CHILD_UNDER_18_EXCLUDING_HOUSEHOLDER_SPOUSE_PARTNER": kids == "none",
            "CHILD_UNDER_18_EXCLUDING_HOUSEHOLDER_SPOUSE_PARTNER": kids != "none",
            "CHILD_IN_BOTH_RANGES_EXCLUDING_HOUSEHOLDER_PARTNER": kids == "both",
            "CHILD_BETWEEN_6_AND_17_EXCLUDING_HOUSEHOLDER_PARTNER": kids == "6to17",
            "CHILD_UNDER_6_ONLY_EXCLUDING_HOUSEHOLDER_SPOUSE_PARTNER": kids == "u6",
            "CHILD_UNDER_18": minor, "MULTIG": multig, "SIZE": size, "MARRIED": married, "COHABITING": cohabiting,
        }
        out.append({k: int(v) for k, v in row.items()})

    for couple in couples:
        adults = 1 if couple == "single" else 2
        if couple == "single":
            for minor in (0, 1):
                add(couple, False, "none", "none", minor, 0, 1)
        for related in (True,) if couple.startswith("married") else (True, False):
            for own in child if related else ("none",):
                for kids in child:
                    if own != "none" and kids not in (own, "both"):
                        continue
                    for minor in (0, 1) if kids == "none" else (1,):
                        lone_minor = couple == "single" and kids == "none" and minor
                        for multig in (0, 1) if related and not lone_minor else (0,):
                            ranges = {"none": 0, "both": 2}.get(kids, 1)
                            if multig:
                                spare = own not in ("none", kids)  # a child that is not the householder's own
                                extra = max(ranges + (0 if spare else 1), 2)
                            else:
                                extra = ranges
                                if not ranges and not couple.startswith("married") and (related or adults == 1):
                                    extra = 1
                            for size in range(adults + extra, 8):
                                add(couple, related, own, kids, minor, multig, size)
    return out


def household_label(t: dict[str, int]) -> str:
    """Description of a household type."""
    if t["SIZE"] == 1:
        return "Size 1, not multig, no spouse or partner, living alone, " + ("c" if t["CHILD_UNDER_18"] else "no c")
    sex = "opposite-sex" if t["MARRIED_OPPOSITE_SEX"] or t["COHABITING_OPPOSITE_SEX"] else "same-sex"
    who = f"married {sex}" if t["MARRIED"] else f"cohabiting {sex}" if t["COHABITING"] else "no spouse or partner"
    other = next((
        n for n, c in (
            ("u6 only", "CHILD_UNDER_6_ONLY_EXCLUDING_HOUSEHOLDER_SPOUSE_PARTNER"),
            ("6to17", "CHILD_BETWEEN_6_AND_17_EXCLUDING_HOUSEHOLDER_PARTNER"),
            ("both", "CHILD_IN_BOTH_RANGES_EXCLUDING_HOUSEHOLDER_PARTNER"),
        ) if t[c]
    ), None)
    if t["NO_OWN_CHILD_UNDER_18"]:
        relatives = "" if t["MARRIED"] else f" with {'no ' if t['NO_RELATIVES'] else ''}relatives,"
        what = "with no oc" if t["MARRIED"] else "no oc"
        if other is None:
            what += ", no cxhhsup" + (", but has c" if t["CHILD_UNDER_18"] else ", no c")
        else:
            what += f", but has cxhhsup {other}" + (" only" if other == "6to17" and t["MARRIED"] else "")
    else:
        relatives = "," if t["NO_SPOUSE_OR_PARTNER"] else ""
        own = "u6 only" if t["OWN_CHILD_UNDER_6_ONLY"] else "6to17 only" if t["OWN_CHILD_BETWEEN_6_AND_17"] else "both"
        what = f"with oc {own}"
        if own != "both":
            what += ", cxhhsup both" if other == "both" else f", no cxhhsup {'6to17' if own == 'u6 only' else 'u6'}"
    size = t["SIZE"] if t["SIZE"] < 7 else "7+"
    return f"Size {size}, {'multig' if t['MULTIG'] else 'not multig'}, {who}{relatives} {what}"


def household_groupings() -> dict[str, list[tuple[str, str]]]:
    """Recode name -> (label, predicate); predicates read the same in Spark SQL."""
    out = {}
    for k, v in _lines(HOUSEHOLD_RECODES):
        out[k] = [tuple(p.rsplit(": ", 1)) for p in v.split(" | ")]
    for k, lists in HOUSEHOLD_CROSSES.items():
        parts = [HOUSEHOLD_LISTS.get(x, x).split() for x in lists]
        out[k] = [(" and ".join(p), " and ".join(p)) for p in product(*parts)]
    return out


def _household() -> Attribute:
    import pandas as pd

    types = household_types()
    table = pd.DataFrame(types)
    a = Attribute("hhtype_dhch", "HHTypeDHCHAttr", [household_label(t) for t in types])
    for name, groups in household_groupings().items():
        rows = [(label, [int(i) for i in table.query(p).index]) for label, p in groups]
        a.recodes[name] = [g for g in rows if g[1] or name not in HOUSEHOLD_CROSSES]
    return a


def load() -> dict[str, Attribute]:
    """All attributes by class name."""
    out = _read()
    _race_recodes(out["CenraceAttr"])
    relgq = out["RelGQAttr"]
    for i, label in enumerate(relgq.levels):
        total = f"{label} Population Total" if i < 41 else f"{label[:-1]} Population Total)"
        relgq.recodes[f"relgq{i}"] = [(total, [i])]
    out["Race2010Attr"] = Attribute("race2010", "Race2010Attr", ["-".join(c) for c in race_combinations(RACES[:5])])
    out["AgeAttr"] = _age("age", "AgeAttr", 116)
    out["AgeEPAttr"] = _age("age_ep", "AgeEPAttr", 101)
    old = _age("age1940", "Age1940Attr", 116)
    old.recodes.update({
        "ageGroups4": old.recodes["agegroup4"], "ageGroups16": old.recodes["agegroup16"], "ageGroups64": old.recodes["agegroup64"],
    })
    out["Age1940Attr"] = old
    out["HHTypeDHCHAttr"] = _household()
    return out


def facility_level(code: str) -> int | None:
    """Level of HHGQAttr for a three-digit facility code."""
    codes = GQ_CODES.split()
    if code in codes:
        return codes.index(code) + 1
    return len(codes) if code in GQ_CODES_TO_LAST.split() else None


ATTRIBUTES = load()
