"""Vehicles, parties and witnesses: table rows, headers, rules and continued names, case by case."""

from fieldloom.operators import crash_tables as ct

DOCS = "doc_id long, text string"


def all_found(spark, reader, texts, **more):
    """What a reader finds in each text, without what is unknown."""
    rows = reader(spark.createDataFrame(list(enumerate(texts)), DOCS), **more).orderBy("doc_id", "entity_no").collect()
    told = lambda r: {k: v for k, v in r.asDict().items() if k not in ("doc_id", "entity_no") and v not in ("Unknown", "None", "None reported", False, [])}
    return [[told(r) for r in rows if r.doc_id == i] for i in range(len(texts))]


def found(spark, reader, text, **more):
    return all_found(spark, reader, [text], **more)[0]


VEHICLE_CASES = [
    # Reports with inline headers, a unit of another service, and a label that only looks like "color".
    ("EMS: County EMS - Unit 14 (treated on scene)\nVEHICLE 1: 2019 Ford F-150 (White)\nVIN: 1FTFW1E50KFB12345\nDRIVER 1: John\n\nVEHICLE 2: 2021 Honda Civic (Silver)\nVIN: 2HGFC2F59MH123456",
     [{"entity_id": "V1", "year": "2019", "make": "Ford", "model": "F-150", "color": "White", "vin": "1FTFW1E50KFB12345"}, {"entity_id": "V2", "year": "2021", "make": "Honda", "model": "Civic", "color": "Silver", "vin": "2HGFC2F59MH123456"}]),
    ("VEHICLE 1: 2020 Toyota Camry\nType of Collision / Vehicles Involved: Rear-End\nVIN: 4T1\nColor: White", [{"entity_id": "V1", "year": "2020", "make": "Toyota", "model": "Camry", "vin": "4T1", "color": "White"}]),
    # Table rows under their columns, with and without a number, a state before and behind the plate.
    ("# Year / Make / Model VIN Plate Damage\nV1 2022 Toyota Tundra Limited 5TFJA5DB2NX041801 TX-PJK-4418 (TX) front\nMot 2020 Harley-Davidson Softail 1HD1YAJ16LB012345 ABC123 (NM) x\nV3 2001 Dodge " + "long name " * 6 + "\nSECTION 3 - DRIVERS\nColor: Red",
     [{"entity_id": "V1", "year": "2022", "make": "Toyota", "model": "Tundra Limited", "vin": "5TFJA5DB2NX041801", "plate": "TX-PJK-4418"},
      {"entity_id": "Mot", "year": "2020", "make": "Harley-Davidson", "model": "Softail", "vin": "1HD1YAJ16LB012345", "plate": "ABC123 (NM)"},
      {"entity_id": "V3", "year": "2001", "make": "Dodge", "model": ("long name " * 6)[:40]}]),
    ("# Year / Make / Model VIN Plate\nV1 no year here\nV2 2022 Toyota Tundra", []),
    # Headers of all kinds.
    ("B. UNIT / VEHICLE #3 (COMMERCIAL) 2020 Kia Rio\nPlate: X1", [{"entity_id": "V3", "plate": "X1"}]),
    ("#: V4\nMake: Seat", [{"entity_id": "V4", "make": "Seat"}]),
    ("V5: Make Ford | Model: Ka | Year/Make/Model: 1999 Opel Corsa | Tag: T1 | nothing", [{"entity_id": "V5", "make": "Ford", "model": "Ka", "year": "1999", "plate": "T1"}]),
    ("Vehicle V6 — 2011 GMC Sierra 1500 (Dark Blue)", [{"entity_id": "V6", "year": "2011", "make": "GMC", "model": "Sierra 1500", "color": "Dark Blue"}]),
    ("Party / Vehicle Driver - Vehicle V1 x\nMake: Z", []),
    ("VEHICLE - STOLEN / INVOLVED\nYear / Make / Model 2022 Toyota RAV4\nVEHICLE - RECOVERED\nMake: Audi", [{"entity_id": "V1", "year": "2022", "make": "Toyota", "model": "RAV4"}, {"entity_id": "V2", "make": "Audi"}]),
    ("Make: Ford\nVIN: 123", []),
    # Rules: the first word counts, a labelled value always does.
    ("Unit 1:\nYear 2025 Make Volvo Trucks Model VHD U\nMake: Mack\nYear 2001 Make Fiat\nColor Navy Blue License Plate / State NM-99 (NM)\nVIN 1HGCM82633A004352\nRegistered Owner Ann Lee\nOwner Address 1 Elm St\n"
     "Insurance Company Acme\nPolicy No. P-1\nTowed from Scene Yes, all\nTowing Company N/A\nTowing Company Hook Ltd\n2019 Ford Focus (Red)",
     [{"entity_id": "V1", "year": "2025", "make": "Mack", "model": "VHD", "color": "Navy Blue", "plate": "NM-99", "vin": "1HGCM82633A004352", "owner_name": "Ann Lee", "owner_address": "1 Elm St",
       "insurance_company": "Acme", "policy_number": "P-1", "towed": "Yes", "towing_company": "Hook Ltd"}]),
    ("V1:\n2019 Ford Focus (Red)\nOwner Name Driver Bob\nDriver 2018 x", [{"entity_id": "V1", "year": "2019", "make": "Ford", "model": "Focus", "color": "Red", "owner_name": "Driver Bob"}]),
    ("V1:\nOwner Name: same as driver\nOwner Address: 5 Oak\nDamages: dent\nDamage: big\nColour:", [{"entity_id": "V1", "owner_name": "5 Oak", "damages": "big", "color": ""}]),
    # A vehicle told twice is one.
    ("V1: Make Ford\nV2: Make Kia\nV1:\nColor: Red\nMake: Fiat", [{"entity_id": "V1", "make": "Fiat", "color": "Red"}, {"entity_id": "V2", "make": "Kia"}]),
    ("V1:(cid:12) Make Ford\r\n(cid:3)\r\nTag: A", [{"entity_id": "V1", "make": "Ford", "plate": "A"}]),
    ("", []),
    (None, []),
]


def test_vehicles(spark):
    for (text, want), got in zip(VEHICLE_CASES, all_found(spark, ct.vehicles, [t for t, _ in VEHICLE_CASES]), strict=True):
        assert got == want, text


PARTY_CASES = [
    # After a closing line nothing opens a party again.
    ("DRIVER 1:\nName: Ann\nSUPPLEMENTAL\nName: Bob\nDRIVER 2:\nName: C", [{"role": "Operator", "name": "Ann"}]),
    ("Passenger 1: Lee\nSECTION 12 - X\nName: Bob", [{"role": "Passenger", "name": "Lee"}]),
    # Table of parties: a row a party, charges behind the license; rows of others end it.
    ("Party Name DOB License Citation\nDriver V1 Morris, Ann Lee 01/02/1990 TX-1234567 Speeding, DUI\nOperator Bo Li 3/4/85 D55512 None\nMotorcyclist Cy Young 5/6/70 C777\nPASSENGERS\nName: Nobody",
     [{"role": "Operator", "name": "Morris, Ann Lee", "dob": "01/02/1990", "license_number": "TX-1234567", "citations": "Speeding, DUI", "citations_list": ["Speeding", "DUI"]},
      {"role": "Operator", "name": "Bo Li", "dob": "3/4/85", "license_number": "D55512"}, {"role": "Operator", "name": "Cy Young", "dob": "5/6/70", "license_number": "C777"}]),
    # Table of passengers and pedestrians: a name cut after an initial goes on in the next line.
    ("Veh Name DOB Injury\nV1 Patricia L. 01/02/1990 Bruise Yes General\nWashington x\nV2 Tom Poe (child) 2/3/2015 none\nPED- Sue Roe (walk 4/5/1980 No\nlater line\nINVESTIGATING OFFICER: x\nName: y",
     [{"role": "Passenger", "name": "Patricia L. Washington", "dob": "01/02/1990", "condition": "Bruise", "injuries": "Bruise", "transported": True},
      {"role": "Passenger", "name": "Tom Poe", "dob": "2/3/2015", "condition": "none", "injuries": "none"}, {"role": "Pedestrian", "name": "Sue Roe", "dob": "4/5/1980"}]),
    # Headers.
    ("Driver Information\nDriver Name Ann Lee DOB 1/2/90\nHome Address 5 Elm St City/State/Zip Waco, TX 76701 Phone (555) 123-4567 DL # D1234567\nInjury Severity Minor Taken To Mercy EMS Run # 7\nCitations Issued Speeding\nCitations Issued DUI",
     [{"role": "Operator", "name": "Ann Lee", "dob": "1/2/90", "address": "5 Elm St, Waco, TX 76701", "phone": "(555) 123-4567", "license_number": "D1234567", "condition": "Minor", "injuries": "Minor",
       "transported": True, "transported_to": "Mercy", "citations": "Speeding, DUI", "citations_list": ["Speeding", "DUI"]}]),
    ("Operator #1 (V1): John Doe (DOB: 1/2/1990)\nVICTIM/COMPLAINANT Jane Roe 3/4/1991 x\nSUSPECT\nName: Unknown male\nParty 4: Bob O'Neil (x)",
     [{"role": "Operator", "name": "John Doe", "dob": "1/2/1990"}, {"role": "Victim", "name": "Jane Roe", "dob": "3/4/1991"}, {"role": "Suspect", "name": "Unknown male"}, {"name": "Bob O'Neil"}]),
    ("DRIVER 1: John\nAddress: 1 Elm\nDriver: Violation 22350\nName: after a charge", [{"role": "Operator", "address": "1 Elm"}]),
    ("Veh: V1 Sam Poe\nDOB: - 1/1/2000 -\nDOB: --\nBicyclist 2: Al", [{"role": "Passenger", "name": "Sam Poe", "dob": "1/1/2000"}, {"role": "Bicyclist", "name": "Al"}]),
    # Labelled values: the last counts, citations and conditions add up, roles follow.
    ("Party 1\nName: A\nFull Name: B\nRole: Driver\nInjuries: cut\nInjury: bruise\nAlcohol test: alcohol found\nRestraint: belt\nCharges: x; y\nCitation: z|w\nTransport unit: None\nSex: M\nState of birth: q",
     [{"role": "Driver", "name": "B", "condition": "bruise  found belt; alcohol", "injuries": "bruise  found belt", "substance_involvement": "alcohol", "transported": True, "citations": "x, y, z, w", "citations_list": ["x", "y", "z", "w"]}]),
    # Rules: the first word counts.
    ("Pedestrian 1\nName Ann Lee (adult)\nName Bob\nDate of Birth 1/2/1990\nDOB 3/4/1991\nDriver's License No. D1\nTransported No way\nTransported To N/A\nCondition / Injury sore",
     [{"role": "Pedestrian", "name": "Ann Lee", "dob": "1/2/1990", "license_number": "D1", "condition": "sore", "injuries": "sore", "transported_to": "N/A"}]),
    ("Name: before any header\nPASSENGER 2\nPhone: 5", []),
    ("", []),
    (None, []),
]


def test_parties(spark):
    for (text, want), got in zip(PARTY_CASES, all_found(spark, ct.parties, [t for t, _ in PARTY_CASES]), strict=True):
        assert got == want, text


WITNESS_CASES = [
    ("WITNESSES & OFFICER\n# Name Address Phone Statement\n1 Shirley Murphy 6413 Jefferson Pkwy, TX (545) 736-9977 Saw it all\n2 Bo Li Main Square (545) 736-9978\n3 Cy\nInvestigating Officer Poe\nName: x",
     [{"name": "Shirley Murphy", "address": "6413 Jefferson Pkwy, TX", "phone": "(545) 736-9977", "statement": "Saw it all"}, {"name": "Bo Li", "address": "Main Square", "phone": "(545) 736-9978", "statement": ""}, {"name": "Cy"}]),
    ("W1: Patricia L.\nGonzalez #4521 said", [{"name": "Patricia L. Gonzalez #4521"}]),
    ("Witness 1: Ann Mc,\nDonald, 5 Elm", [{"name": "Ann Donald"}]),
    ("W1: John Smith stopped\nWalker\nW2: Al Poe — (555) 1234567 — saw it", [{"name": "John Walker"}, {"name": "Al Poe", "phone": "(555) 1234567", "statement": "saw it"}]),
    ("W1: Patricia L.\nSECTION 9", [{"name": "Patricia L."}]),
    ("Witness W1 — Ann Lee, 5 Elm St (555) 123-4567 Yes — she saw\nmore\nAddress: 7 Oak\nDOB: 1/1/90", [{"name": "Ann Lee", "address": "7 Oak", "phone": "(555) 123-4567", "statement": "she saw", "dob": "1/1/90"}]),
    ("WITNESSES\nName: Bo\nTel: 5\nW2: Cy - heard it\nStatement: nothing", [{"name": "Bo", "phone": "5"}, {"name": "Cy", "statement": "nothing"}]),
    ("Name: x\nStatement: y", []),
    (None, []),
]


def test_witnesses(spark):
    for (text, want), got in zip(WITNESS_CASES, all_found(spark, ct.witnesses, [t for t, _ in WITNESS_CASES]), strict=True):
        assert got == want, text


def test_learned_headers(spark):
    text = "V1:\nChassis Ref.: X9\nLic Tag Ref: P1\nDRIVER 1:\nWho: Ann\nBorn: 1/2/90"
    assert found(spark, ct.vehicles, text) == [{"entity_id": "V1", "plate": "P1"}]
    assert found(spark, ct.vehicles, text, aliases={"vin": ["Chassis Ref."], "plate": ["ref"]})[0] == {"entity_id": "V1", "plate": "P1"}
    assert found(spark, ct.vehicles, text, aliases={"vin": ["chassis ref"]})[0]["vin"] == "X9"
    assert found(spark, ct.parties, text) == []
    assert found(spark, ct.parties, text, aliases={"name": ["Who"], "dob": ["born"]}) == [{"role": "Operator", "name": "Ann", "dob": "1/2/90"}]


def test_nothing_is_shuffled(spark):
    docs = spark.createDataFrame([(1, "V1: Make Ford")], DOCS)
    for reader in (ct.vehicles, ct.parties, ct.witnesses):
        assert "Exchange" not in reader(docs)._jdf.queryExecution().executedPlan().toString()
