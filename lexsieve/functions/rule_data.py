"""Rule tables, one line a rule. rules.py compiles them; order within a table is its precedence.

`a | b` are alternatives, `[x]` is optional, `~` any one character, `#` a group of digits, `@` a date; blanks match white space.
A rule matches whole words unless said otherwise.
"""

#: weight; kind; phrases (each a rule of its own)
TRIGGERS = """
1.0; mandatory; shall / shall ensure / shall submit / shall report / shall maintain / shall obtain / shall intimate / shall notify
1.0; mandatory; shall put in place / shall formulate / shall frame / shall constitute / shall appoint / shall designate / shall review
1.0; mandatory; shall conduct / shall carry out / shall implement / shall comply / shall adhere
1.0; prohibition; shall not / shall refrain from
0.95; mandatory; must
0.95; prohibition; must not
0.9; mandatory; is required to / are required to / is obligated to / is mandated to
0.8; discretionary; may
0.85; discretionary; at its discretion
1.0; approval_required; subject to prior approval / with the prior approval of / subject to approval of[ the] reserve bank
0.7; recommendation; should
0.6; recommendation; is encouraged to
0.55; recommendation; would be advisable
1.1; mandatory!immediate; shall take immediate steps / shall forthwith / shall without delay / shall at the earliest
"""

NEGATIONS = """
1.0; prohibition; shall not / must not / no bank shall / no regulated entity shall / not permitted to / is prohibited from
1.0; prohibition; shall not be permitted to / shall not engage in
0.9; limit; shall not exceed
0.9; floor; shall not be less than
1.0; prohibition; shall refrain from
0.95; prohibition_without_approval; without the prior approval / except with the prior written consent
0.5; interpretive_limit; not be construed as
"""

#: weight; scope; canonical actor; alternatives
ACTORS = """
1.0;; Board of Directors; board of directors
0.9;; Board of Directors; board['s| level] (committee|sub-committee)
1.0;; Chief Executive Officer; chief executive officer | ceo
1.0;; Chief Compliance Officer; chief compliance officer | cco
1.0;; CISO; chief information security officer | ciso
1.0;; Chief Risk Officer; chief risk officer | cro
0.9;; Managing Director; managing director | md
1.0; RBI IBA; Scheduled Commercial Bank; scheduled commercial bank[s]
1.0; RBI IBA; Public Sector Bank; public sector bank[s]
1.0; RBI IBA; Private Sector Bank; private sector bank[s]
1.0; RBI IBA; Foreign Bank; foreign bank[s]
1.0; RBI IBA; Cooperative Bank; co-operative bank[s] | cooperative bank[s]
1.0; RBI IBA; Small Finance Bank; small finance bank[s]
1.0; RBI IBA NPCI; Payments Bank; payments bank[s]
1.0; RBI IBA; Regional Rural Bank; regional rural bank[s] | rrb[s]
1.0; RBI; NBFC; non~banking financial compan(y|ies) | nbfc[s]
1.0; RBI; NBFC-MFI; nbfc~mfi[s] | nbfc~micro finance
1.0; RBI; Housing Finance Company; housing finance compan(y|ies) | hfc[s]
1.0; RBI; Authorised Dealer Category I Bank; authorised dealer category[~]i[i] bank[s] | ad cat[egory][~]i[i]
1.0;; Payment System Operator; payment system operator[s] | pso[s]
1.0;; Payment System Participant; payment system participant[s]
0.9;; PPI Issuer; prepaid payment instrument[s] | ppi
0.95;; Regulated Entity; all regulated entit(y|ies) | regulated entit(y|ies) | all re
1.0;; RBI; reserve bank of india | the reserve bank | rbi
0.85; RBI IBA NPCI; Bank; the bank[s] | a bank[s] | banks
0.8;; Customer; customer[s]
0.8;; Borrower; borrower[s]
0.8;; Depositor; depositor[s]
0.85;; Outsourced Service Provider; outsourced service provider[s] | service provider[s]
0.85;; Third-Party Service Provider; third~party service provider[s]
0.85;; System Provider; system provider[s]
0.9;; Auditor; internal auditor[s] | statutory auditor[s]
0.9;; Principal Officer; principal officer
0.95; IRDAI; Insurer; insurance compan(y|ies)
1.0; IRDAI; Life Insurer; life insur(er|ance)[s]
1.0; IRDAI; General Insurer; general insur(er|ance)[s]
1.0; IRDAI; Health Insurer; health insur(er|ance)[s]
0.9; IRDAI; Insurer; the insurer[s] | all insurers | an insurer
1.0; IRDAI; Reinsurer; reinsurer[s] | the reinsurer[s]
1.0; IRDAI; GIC Re; gic[ ]re | general insurance corporation
1.05; IRDAI; FRBs/Reinsurers; frb[s][/reinsurer[s]] | foreign reinsurance branch[es]
0.8; IRDAI; Policyholder; policyholder[s] | policy[ ]holder[s]
1.0; IRDAI; Appointed Actuary; appointed actuary | the actuary
0.9; IRDAI; Third Party Administrator; third~party administrator[s] | tpa[s]
0.9; IRDAI; Insurance Broker; insurance broker[s] | composite broker[s]
0.9; IRDAI; Corporate Agent; corporate agent[s]
0.9; IRDAI; Insurance Surveyor; insurance surveyor[s] | surveyor and loss assessor[s]
1.0; IRDAI; IRDAI; irdai | insurance regulatory and development authority | the authority
"""

#: urgency (? is worked out from number and unit); duration; pattern
DEADLINES = """
immediate;; with immediate effect
immediate;; immediately
immediate;; forthwith
immediate;; at the earliest
immediate;; without delay
immediate; 6 hours; within (six|6) hours
immediate; 24 hours; within (twenty~four|24) hours
immediate; 48 hours; within (forty~eight|48) hours
immediate; 72 hours; within (seventy~two|72) hours
immediate; 1 day; within (one|1) [working ]day
immediate; 3 days; within (three|3) [working |calendar ]days
immediate; 5 days; within (five|5) [working |calendar ]days
short_term; 7 days; within (seven|7) [working |calendar ]days
short_term; 15 days; within (fourteen|15) [working |calendar ]days
short_term; 30 days; within (thirty|30) [working |calendar ]days
short_term; 30 days; within (one|1) month
short_term; 45 days; within (forty~five|45) days
medium_term; 60 days; within (sixty|60) days
medium_term; 60 days; within (two|2) months
medium_term; 90 days; within (ninety|90) days
medium_term; 90 days; within (three|3) months
medium_term; 180 days; within (six|6) months
long_term; 365 days; within (one|1) year
long_term; 730 days; within (two|2) years
?; *; within # {calendar days|working days|days|weeks|months|years}
?; *; for a period not exceeding {\\d+|[a-z]+} {days|weeks|months|years}
triggered; @; with effect from @
triggered; @; come into force (on|from) @
short_term; @; by %
ongoing; quarterly; quarterly | every quarter | on a quarterly basis
ongoing; monthly; monthly | every month | on a monthly basis
ongoing; annually; annually | every year | on an annual basis | every financial year
ongoing; half-yearly; half~yearly | every six months
ongoing;; on a continuous basis | at all times | permanently
triggered;; before commencement of
?; *; not later than # {days|months|years}
?; *; within a period of # {days|months|years}
short_term; @; on or before @
short_term; 30 days; beyond (thirty|30) [working |calendar ]days
?; *; beyond # {days|months|years}
"""

#: what the found date is; pattern. `%` is a date that begins with the month's name
EFFECTIVE_DATES = """
date; with effect from %
date; with effect from &
date; shall come into force (on|from) %
date; shall be effective from %
date; shall be operative from %
date; these directions shall come into effect (on|from) %
date; these[ master] direction[s] shall (come into force|be applicable) (on|from|w\\.e\\.f[\\.]) @
date; w\\.e\\.f[\\.] @
issue; immediately upon publication | upon issuance | from the date of issuance
none; supersede[s|d] [the ](circular|direction|instruction) {[a-z][-a-z./\\d]+}
year; (effective|with effect|applicable) from [the ]financial year $
year; (effective|with effect|applicable) from [the ]fy[ ]$
"""

#: domain; keywords; phrases (two points each)
DOMAINS = """
KYC_AML; aadhaar, address proof, aml, anti-money laundering, beneficial owner, cash transaction report, cdd, correspondent banking, ctr, customer due diligence, customer risk categorisation, edd, enhanced due diligence, identity verification, know your customer, kyc, pan card, pep, periodic updation, pmla, politically exposed person, prevention of money laundering, re-kyc, risk based approach, sanctions, shell companies, small accounts, str, suspicious transaction, uapa, ubo, wire transfer; beneficial ownership, cash transaction report, customer due diligence, enhanced due diligence, periodic updation of kyc, risk based customer acceptance, suspicious transaction report, wire transfer regulations
Cybersecurity; access control, application security, cert-in, cyber, cyber drill, cyber hygiene, cyber resilience, cybersecurity, data breach, ddos, denial of service, encryption, endpoint security, firewall, incident response, information security, information systems audit, infosec, intrusion detection, is audit, malware, mfa, multi-factor authentication, network security, patch, penetration testing, phishing, privileged access, ransomware, security audit, security operations centre, soc, vapt, vulnerability, zero trust; cyber security framework, data loss prevention, incident response plan, information security policy, penetration testing, privileged access management, security operations centre, security patch management, vulnerability assessment
DataPrivacy; aadhaar data, biometric data, consent, data fiduciary, data localisation, data minimisation, data principal, data privacy, data processor, data protection, data retention, dpdp, gdpr, personal data, personal information, pii, privacy policy, right to erasure, sensitive personal data; consent management, data localisation requirements, data principal rights, data retention policy, digital personal data protection
FinancialInclusion; banking outlet, basic savings, bc, business correspondent, economically weaker section, ews, financial inclusion, jan dhan, micro credit, no-frills account, pmjdy, priority sector, rural, self help group, semi-urban, shg, unbanked, underserved, village level entrepreneur, weaker section; banking services in unbanked areas, basic savings bank deposit account, business correspondent network, financial literacy, priority sector lending
BusinessContinuity; alternate site, bcp, business continuity, business resumption, calamity, critical operations, disaster recovery, dr site, drp, earthquake, failover, flood, natural disaster, pandemic, recovery point objective, recovery time objective, restoration, resumption, rpo, rto, temporary premises; business continuity plan, critical system restoration, disaster recovery plan, recovery point objective, recovery time objective, temporary banking premises
FraudManagement; account takeover, advance fee fraud, atm fraud, card fraud, cyber fraud, fraud, fraudulent, identity theft, mis-selling, misrepresentation, mule account, phishing, skimming, smishing, social engineering, staff fraud, unauthorised transaction, vishing; customer liability in fraud, fraud monitoring, fraud reporting, fraud risk management, unauthorised electronic transaction
CapitalAdequacy; basel, capital adequacy, capital conservation buffer, capital planning, ccb, cet1, countercyclical buffer, crar, credit risk capital, icaap, leverage ratio, market risk capital, minimum capital requirement, npa provisioning, operational risk capital, pcr, provision coverage ratio, risk weighted assets, rwa, tier 1, tier 2; capital adequacy ratio, capital conservation buffer, internal capital adequacy assessment, pillar 2 requirements, risk weighted assets
Payments; atm, card network, cheque, clearing, dd, demand draft, ecs, emi, escrow, imps, internet banking, interoperability, mandate, mastercard, mobile banking, nach, neft, net banking, nodal account, npci, payment, payment gateway, point of sale, pos terminal, ppi, prepaid, recurring payment, rtgs, rupay, satellite office, settlement, upi, visa, wallet; automated teller machine, mobile banking facilities, national electronic funds transfer, payment and settlement systems, point of sale terminal, prepaid payment instrument, real time gross settlement, unified payments interface
CustomerService; accessibility, banking ombudsman, charges, compensation, complaint, cooling off period, customer rights, customer service, differently abled, disclosure, doorstep banking, fair practices, fees, grievance, grievance redressal, integrated ombudsman scheme, interest, ombudsman, penalty, refund, service charges, transparency, waiver; banking ombudsman scheme, customer complaint, fair practices code, grievance redressal mechanism, integrated ombudsman scheme, key fact statement, most important terms and conditions
Governance; accountability, audit committee, board, board of directors, compliance function, conflict of interest, corporate governance, disclosure, fit and proper, governance, independent director, internal control, nomination committee, non-executive director, policy framework, related party, remuneration, risk management committee, transparency, whistle blower; audit committee of the board, board of directors, corporate governance guidelines, fit and proper criteria, internal controls framework, related party transactions, risk management committee
ITInfrastructure; api, archival, backup, capacity planning, cbs, change management, cloud, cloud computing, core banking, data centre, database, hardware, it governance, it infrastructure, it policy, legacy system, middleware, patch management, release management, server, software update, system availability, uptime, virtualisation; change management process, cloud adoption framework, core banking solution, data centre operations, information technology governance, system availability requirements
ReportingAudit; acknowledgement, annual report, audit report, data submission, disclosure, filing, form, inspection report, intimation, monthly report, off-site surveillance, onsite inspection, prescribed format, quarterly report, regulatory return, report, return, statutory return, submit, supervisory review, weekly report; annual compliance report, inspection findings, off-site surveillance data, quarterly return, regulatory reporting, statutory audit report, submit a report
HR_Training; appointment, awareness programme, capacity building, code of conduct, compensation, conduct, employee, ethics, human resources, personnel, recruitment, remuneration, skill development, staff, training, vigilance, whistle blower, workforce; awareness training, capacity building initiative, employee code of conduct, human resource policy, staff training programme
FEMA; ad, authorised dealer, capital account, current account, ecb, export, external commercial borrowing, fdi, fema, foreign currency, foreign direct investment, foreign exchange, forex, import, liberalised remittance scheme, lrs, money transfer, non-resident, nri, odi, overseas direct investment, rda, remittance, rupee drawing arrangement, trade credit; authorised dealer category, current account transactions, external commercial borrowing, foreign direct investment, foreign exchange management act, liberalised remittance scheme, overseas direct investment
"""

#: Further keywords of sector packs, in pack order; each line is weighed by itself
DOMAIN_ADDITIONS = """
CapitalAdequacy; cash reserve ratio, crr, lcr, liquidity coverage ratio, liquidity risk management, lrm, net stable funding ratio, nsfr, pcr, provision coverage, slr, statutory liquidity ratio
ReportingAudit; basic statistical returns, bsr, dbie, dsim returns, form a, form b, offsite surveillance, quarterly return, regulatory reporting portal, xbrl
Governance; board diversity, ceo succession, fit and proper, ras, remuneration committee, risk appetite statement, tenure
Payments; acquirer, card on file, cof, iso 20022, issuer, pa, payment aggregator, pg, swift, tokenisation
FEMA; advance remittance, annual performance report, apr, buyers credit, compounding, contraventions, ecb 2 return, form ecb, form fc-gpr, form fc-trs, form odi, import payments, loan registration number, lrn, money transfer service scheme, mtss, nostro reconciliation, rda, regularisation, rupee drawing arrangement, suppliers credit, trade credit, transfer of shares, usance, vostro
CapitalAdequacy; alm, asset liability management, concentration risk, crar nbfc, net owned fund, nof, tier i capital nbfc
ReportingAudit; annual return for nbfc, nbs returns, nbs-1, nbs-2, nbs-6, nbs-7, statutory auditor certificate
Governance; alco, asset liability committee, board approved policy nbfc, internal audit function nbfc, risk management committee nbfc
Payments; card tokenisation, chargeback, cof tokenisation, dispute resolution, failed transaction, float, full kyc, interchange fee, issuance guidelines, mdr, merchant discount rate, minimum kyc, nodal account, pa, payment aggregator, payment gateway, pg, reversal, settlement cycle, wallet kyc
Cybersecurity; 2fa, dynamic otp, end to end encryption, fraud analytics, otp, payment card industry, pci dss, ssl, tls, tokenisation payment, two factor authentication
CapitalAdequacy; cirp, corporate insolvency resolution process, doubtful, ibc, ibc moratorium, insolvency, loss asset, nclt, npa recognition, one time settlement, ots, provisioning, resolution plan, restructuring, sma, sma-0, sma-1, sma-2, special mention account, sub-standard, technical write-off, write-off
"""

#: sub-type; floor of severity; phrases
SUB_TYPES = """
reporting; high; shall communicate, shall disclose, shall file, shall forward, shall furnish, shall intimate, shall place on record, shall provide, shall publish, shall report, shall send, shall submit
approval_required; high; prior permission of, prior written consent, shall not undertake without, shall obtain prior approval, subject to approval of, subject to prior approval, with the prior approval
governance; medium; annual review by the board, board approved, board level policy, board of directors shall, board shall, shall appoint a, shall be placed before the board, shall constitute a committee, shall designate, shall formulate, shall frame a policy, shall review periodically
record_retention; medium; documentary evidence shall be maintained, records shall be preserved, shall be maintained for a period, shall keep records, shall maintain records, shall preserve, shall retain
implementation; medium; shall activate, shall deploy, shall establish, shall implement, shall install, shall introduce, shall operationalise, shall put in place, shall set up
audit; medium; annual audit, concurrent audit, information systems audit, is audit, shall be audited, shall be subject to audit, shall carry out audit, shall conduct an audit, shall undergo an audit
customer_protection; high; right of the customer, shall compensate, shall credit within, shall ensure customer, shall not charge, shall not discriminate, shall not levy, shall offer, shall provide free, shall redress, shall resolve grievance, shall waive
kyc_due_diligence; high; shall apply edd, shall carry out cdd, shall conduct customer due diligence, shall identify, shall not open, shall obtain, shall perform enhanced due diligence, shall re-kyc, shall update kyc, shall verify
incident_reporting; critical; incident report shall be submitted, shall file a report with, shall immediately report, shall intimate rbi, shall notify rbi, shall report the incident, shall report within
prohibited_activity; high; is prohibited from, must not, no bank shall, no regulated entity shall, not permitted to, shall not, shall not accept, shall not engage in, shall not lend, shall refrain from
permitted_activity; low; at its discretion, may
conditional_obligation; medium; if, in case of, in the case where, in the event of, on the occurrence of, provided that, subject to, upon declaration of, where
capital_adequacy; critical; capital conservation buffer, leverage ratio shall, minimum capital requirement, shall maintain a capital adequacy ratio, shall maintain cet1, shall maintain crar, shall not fall below
outsourcing; medium; before outsourcing, due diligence on the service provider, exit strategy, outsourcing agreement shall, shall ensure the outsourced, shall monitor the service provider, shall not outsource
business_continuity; high; business continuity plan, disaster recovery plan, recovery point objective, recovery time objective, rpo, rto, shall conduct a dr drill, shall resume operations within, shall test the bcp
"""

#: severity; conditions (name = values; "has" asks for all of its keywords)
SEVERITIES = """
critical; urgency = immediate
critical; sub_type = incident_reporting
critical; has = criminal & imprisonment & monetary penalty & penalty & prosecution
critical; has = customer harm & customer safety & loss of customer funds
critical; domain = CapitalAdequacy; has = breach & cet1 falls below & crar & minimum capital
critical; domain = Cybersecurity; has = critical & data breach & material breach & ransomware & system compromise
high; urgency = short_term
high; sub_type = reporting; urgency = short_term, medium_term
high; sub_type = customer_protection
high; sub_type = kyc_due_diligence; has = edd & enhanced due diligence & high risk & pep & sanctions
high; sub_type = prohibited_activity
high; domain = FraudManagement; has = lodge complaint & notify rbi & report fraud
medium; urgency = medium_term; obligation_type = mandatory
medium; sub_type = governance
medium; sub_type = audit
medium; sub_type = record_retention
medium; sub_type = business_continuity
low; obligation_type = discretionary
low; urgency = long_term, ongoing; obligation_type = recommendation
low; sub_type = permitted_activity
"""

DOMAIN_DEPARTMENTS = """
KYC_AML: AML_KYC Operations Compliance
Cybersecurity: Cybersecurity IT Compliance
DataPrivacy: IT Legal Compliance
FinancialInclusion: BranchNetwork Operations Compliance
BusinessContinuity: IT Operations BranchNetwork Compliance
FraudManagement: FraudManagement Operations IT
CapitalAdequacy: RiskManagement Finance Compliance
Payments: Operations DigitalBanking IT
CustomerService: CustomerService RetailBanking Finance Compliance
Governance: Compliance Legal
ITInfrastructure: IT DigitalBanking Operations
ReportingAudit: Compliance InternalAudit Finance
HR_Training: HR Compliance
FEMA: Treasury Compliance Legal
Other: Compliance
"""

SUB_TYPE_DEPARTMENTS = """
reporting: Compliance InternalAudit
approval_required: Compliance Legal
governance: Compliance Legal
record_retention: Operations IT Compliance
implementation: IT Operations
audit: InternalAudit Compliance
customer_protection: CustomerService RetailBanking Compliance
kyc_due_diligence: AML_KYC Operations
incident_reporting: Cybersecurity IT Compliance
prohibited_activity: Compliance Legal
capital_adequacy: RiskManagement Finance
outsourcing: Legal Compliance IT Operations
business_continuity: IT Operations Compliance
"""

SIGNAL_DEPARTMENTS = """
atm, cash, currency chest, vault: Operations BranchNetwork
app, internet banking, mobile banking, upi: DigitalBanking IT
charge, fee, refund, waiver: RetailBanking Finance CustomerService
banking outlet, branch, satellite office: BranchNetwork Operations
derivative, forex, swap, treasury: Treasury
advance, credit, loan, npa, npl: RiskManagement
arbitration, court, legal, tribunal: Legal
board, committee, directors: Compliance Legal
awareness, employee, staff, training: HR
cloud, data centre, infrastructure, server: IT
"""

ACTOR_DEPARTMENTS = """
Board of Directors: Compliance Legal
Chief Compliance Officer: Compliance
CISO: Cybersecurity IT
Chief Risk Officer: RiskManagement
Auditor: InternalAudit
Principal Officer: AML_KYC Compliance
"""

#: clause type; weight; any of
CLAUSE_TYPES = """
obligation; 1.0; is mandated, is obligated, must, required to, shall
permission; 0.9; at its discretion, may, permitted to
prohibition; 1.0; must not, not permitted, prohibited from, shall not
definition; 0.9; defined as, includes, means, shall include, shall mean
penalty; 1.0; fine, imprisonment, levied, penalty, prosecution
cross_reference; 0.85; as directed by, as per, as specified in, in accordance with, refer to
effective_date; 1.0; come into effect, come into force, shall be applicable from, with effect from
quoted_reference; 1.1; is extracted below, is quoted below, is reproduced below, provides as follows, provides as under, reads as follows, reads as under, states as follows, states as under, stipulates as follows, stipulates as under
"""

#: pack; actors; then its rules: id, name; domain; sub-type; deadline (text/duration/urgency); severity; phrases
SECTORS = """
= aml; Bank, NBFC, Payment System Operator, Principal Officer
AO-001 str_filing; KYC_AML; reporting; within 7 days/7 days/short_term; critical; shall file str, shall report suspicious, str, suspicious transaction report
AO-002 ctr_filing; KYC_AML; reporting; within 15 days/15 days/short_term; high; cash transaction exceeding, cash transaction report, ctr, transactions above rs. 10 lakh
AO-003 sanctions_screening; KYC_AML; compliance; ; critical; designated entities, sanctions list, shall screen, uapa, un security council
AO-004 wire_transfer_originator_info; KYC_AML; compliance; ; high; beneficiary information, cross-border transfer, originator information, shall include name and address, wire transfer
AO-005 aml_programme; KYC_AML; governance; ; high; aml programme, anti-money laundering programme, internal controls for aml, shall adopt policies and procedures
AO-006 principal_officer_designation; KYC_AML; governance; ; high; principal officer, responsible for pmla
AO-007 record_retention_aml; KYC_AML; record_retention; ; high; for a period of five years, for a period of ten years, retain aml records, shall preserve records
= banking; Scheduled Commercial Bank, Small Finance Bank, Payments Bank, Bank
BO-001 slr_maintenance; CapitalAdequacy; capital_adequacy; ; critical; shall hold in approved securities, shall maintain slr, statutory liquidity ratio
BO-002 crr_maintenance; CapitalAdequacy; capital_adequacy; ; critical; average daily balance, cash reserve ratio, shall maintain crr
BO-003 psl_target; FinancialInclusion; reporting; ; high; adjusted net bank credit, anbc, priority sector lending, psl target
BO-004 irac_provisioning; CapitalAdequacy; capital_adequacy; ; high; asset classification, doubtful, income recognition, loss asset, npa, provisioning norms, sub-standard
BO-005 large_exposure_reporting; CapitalAdequacy; reporting; ; high; exposure ceiling, group borrower limit, large exposure, single borrower limit
= customer_service; Bank, NBFC, Payment System Operator, Regulated Entity
CS-001 complaint_resolution_timeline; CustomerService; customer_protection; within 30 days/30 days/short_term; high; complaint resolution, shall resolve the complaint within 30 days, shall respond to complaint, turnaround time for complaints
CS-002 no_charges_basic_services; CustomerService; prohibited_activity; ; high; free of charge, no fee for, shall not charge, shall not levy
CS-003 key_fact_statement; CustomerService; implementation; ; medium; key fact statement, kfs, mitc, most important terms and conditions
CS-004 doorstep_banking; CustomerService; implementation; ; medium; differently abled, door step banking services, doorstep banking, senior citizen
CS-005 grievance_officer_designation; CustomerService; governance; ; medium; grievance redressal officer, nodal officer for complaints, shall designate a nodal officer
= cyber; Bank, NBFC, Payment System Operator, Regulated Entity
CO-001 cyber_incident_initial_report; Cybersecurity; incident_reporting; within 6 hours/6 hours/immediate; critical; initial report within, shall notify cert-in, shall report the cyber incident, within six hours
CO-002 cyber_incident_detailed_report; Cybersecurity; reporting; within 72 hours/72 hours/immediate; critical; detailed report within, final incident report, root cause analysis, within 72 hours
CO-003 patch_management; Cybersecurity; implementation; ; high; patch within, security patch, shall apply patches, vulnerability management
CO-004 vapt_annual; Cybersecurity; audit; ; high; annual security audit, at least once a year, penetration testing, vapt, vulnerability assessment
CO-005 soc_establishment; Cybersecurity; implementation; ; high; 24x7 monitoring, security operations centre, soc
CO-006 is_policy; Cybersecurity; governance; ; high; cyber security policy, information security policy, is policy
CO-007 third_party_audit; Cybersecurity; audit; ; medium; external audit of it systems, is audit by third party, third party audit
CO-008 data_localisation; DataPrivacy; implementation; ; critical; data localisation, data shall be stored only in india, no storage of payment data outside india
CO-009 bcp_dr_drill; BusinessContinuity; business_continuity; ; high; bcp test, business continuity test, disaster recovery drill, dr drill
= digital_banking; Bank, Payment System Operator, Small Finance Bank
DB-001 internet_banking_security; Cybersecurity; implementation; ; high; internet banking, net banking, online banking security, shall implement additional factor
DB-002 mobile_banking_registration; Payments; implementation; ; medium; mobile banking registration, mobile number seeding, shall enable mobile banking
DB-003 transaction_alert; CustomerService; customer_protection; ; high; email alert for transaction, shall notify customer, shall send sms alert, transaction alert
DB-004 cooling_period; FraudManagement; implementation; ; high; cooling period, mandatory cooling off, new beneficiary cooling
= fema; Authorised Dealer Category I Bank, Authorised Dealer, AD Category I
FO-001 ecb_reporting; FEMA; reporting; ; high; ecb 2 return, loan registration number, shall file form ecb, shall report ecb
FO-002 fdi_reporting; FEMA; reporting; ; high; advance reporting form, form fc-gpr, form fc-trs, shall report fdi
FO-003 lrs_monitoring; FEMA; compliance; ; medium; annual limit, liberalised remittance scheme, lrs, usd 250\\,000
FO-004 nostro_reconciliation; FEMA; record_retention; ; high; nostro account reconciliation, shall reconcile, within five days
FO-005 apr_filing; FEMA; reporting; ; high; annual performance report, apr, overseas investment
= financial_inclusion; Bank, Small Finance Bank, Regional Rural Bank
FI-001 bsbda_opening; FinancialInclusion; implementation; ; medium; basic savings bank deposit account, bsbda, no-frills account, shall offer basic savings
FI-002 bc_network_management; FinancialInclusion; governance; ; medium; bc agent, bc network, business correspondent, shall ensure bc, village level entrepreneur
FI-003 psl_reporting; FinancialInclusion; reporting; quarterly//ongoing; high; adjusted net bank credit, anbc, priority sector, psl
FI-004 financial_literacy_programme; FinancialInclusion; implementation; ; low; awareness programme, financial education, financial literacy
= kyc; Bank, NBFC, Payment System Operator, Regulated Entity
KO-001 cdd_at_account_opening; KYC_AML; kyc_due_diligence; ; high; at account opening, before establishing a business relationship, shall obtain and verify
KO-002 periodic_kyc_updation; KYC_AML; kyc_due_diligence; ; high; every ten years, every two years, kyc refresh, periodic updation, re-kyc
KO-003 enhanced_due_diligence; KYC_AML; kyc_due_diligence; ; critical; edd, enhanced due diligence, high risk country, high risk customer, pep, politically exposed person
KO-004 beneficial_ownership; KYC_AML; kyc_due_diligence; ; high; 25 per cent, beneficial owner, controlling interest, ubo
KO-005 vkyc_procedure; KYC_AML; implementation; ; medium; v-cip, video based customer identification, video kyc, vkyc
KO-006 account_freeze_restriction; KYC_AML; prohibited_activity; ; high; pending kyc updation, shall freeze, shall not allow, shall restrict operations
KO-007 customer_risk_categorisation; KYC_AML; governance; ; medium; customer risk profile, high risk, low risk, medium risk, risk based approach, risk categorise
KO-008 small_account_monitoring; KYC_AML; compliance; ; medium; aggregate credit, aggregate transfers, aggregate withdrawal, small account
= nbfc; NBFC, NBFC-MFI, Housing Finance Company, NBFC-D, NBFC-ND
NO-001 nof_maintenance; CapitalAdequacy; capital_adequacy; ; critical; minimum nof, net owned fund, shall maintain nof of
NO-002 fair_practices_code; CustomerService; governance; ; medium; fair practices code, fpc, shall adopt fair practices
NO-003 alm_policy; CapitalAdequacy; governance; ; high; alco, alm policy, asset liability management, liquidity risk management nbfc
NO-004 nbfc_registration; Governance; approval_required; ; critical; certificate of registration, cor, shall not commence business without
NO-005 mfi_qualifying_asset; FinancialInclusion; compliance; ; high; 75 per cent, 85 per cent of net assets, micro credit, qualifying asset
= payments; Payment System Operator, Payment System Participant, PPI Issuer, Payment Aggregator
PO-001 refund_timeline; CustomerService; customer_protection; within 5 days/5 days/short_term; high; failed transaction reversal, shall credit the refund within, shall reverse within
PO-002 nodal_account_reporting; Payments; record_retention; ; high; escrow account, settlement account, shall maintain a nodal account
PO-003 card_on_file_tokenisation; Payments; implementation; ; critical; card on file, cof tokenisation, shall not store, shall tokenise
PO-004 ppi_kyc_upgrade; KYC_AML; kyc_due_diligence; ; high; full kyc ppi, minimum kyc limit, upgrade wallet, wallet kyc
PO-005 system_availability; ITInfrastructure; implementation; ; high; downtime, shall ensure availability of, system availability, uptime
= stressed_assets; Scheduled Commercial Bank, NBFC, Bank
SA-001 sma_reporting; CapitalAdequacy; reporting; ; high; overdue, shall classify as sma, sma classification, special mention account
SA-002 npa_provisioning; CapitalAdequacy; capital_adequacy; ; high; provision coverage, provision for npa, provisioning norms, shall make provision
SA-003 crilc_reporting; ReportingAudit; reporting; monthly//ongoing; high; central repository of information on large credits, crilc
SA-004 resolution_framework; CapitalAdequacy; implementation; ; high; 30-day review period, resolution framework, resolution plan, shall implement resolution
"""

BOILERPLATE = "being satisfied that it is necessary, come into effect, come into force, expedient in the public interest, hereby issues the following, in exercise of the powers, is hereby issued, shall be called, shall be cited as, shall be known as, shall be titled, these amendment directions shall, these directions shall, these guidelines shall, these regulations shall, this circular shall"
LEAD_INS = "are extracted below, are reproduced below, as follows:, as hereunder:, as under:, is extracted below, is quoted below, is reproduced below, is set out below, provides as follows, provides as under, reads as follows, reads as under, states as follows, states as under, states that, stipulates as follows, stipulates as under"
RESTARTS = "accordingly, all regulated entities shall, banks shall, in view of the above, insurers shall, it has now been decided, it is advised, it is hereby directed, with effect from"
ISSUER_SIGNALS = "being satisfied, expedient in the public interest, hereby directs, hereby issues, hereby notifies, in exercise of the powers, in exercising its powers, reserve bank hereby, the authority directs, the authority has decided, the authority hereby"
REPORTING_TERMS = "annual report, disclose, file, furnish, intimate, provide, publish, report, return, statement, submit"
APPROVAL_TERMS = "approval, permission"
PROHIBITION_TERMS = "must not, not permitted, prohibited, shall not"

#: Cross references, as regular expressions without case; in order
CROSS_REFERENCES = [
    r"(?:RBI|Reserve{s}Bank{s}of{s}India){n80}(?:Guideline|Instruction|Notification|Direction|Circular){n50}(?:No\.{z})?(?:RBI/{y}-\d{{2,4}}/\d+|[A-Z][-\dA-Z./]+)",
    r"Master{s}Directions?{s}(?:on{s}|[–-]{s})?{title}",
    r"Master{s}Circular{s}(?:on{s}|[–-]{s})?{title}",
    r"FEMA{s}\d+(?:\([A-Z]+\))?(?:/{y}-RB)?|Foreign{s}Exchange{s}Management{act}",
    r"Banking{s}Regulation{act}|{sec}Banking{s}Regulation{s}Act",
    r"Reserve{s}Bank{s}of{s}India{act}|{sec}RBI{s}Act",
    r"Prevention{s}of{s}Money{s}Laundering{act}|PMLA(?:,?{s}{y})?",
    r"Payment{s}and{s}Settlement{s}Systems{act}|PSS{s}Act",
    r"Companies{act}",
    r"(?:Master{s}Directions?{s}on{s})?(?:NBFC|Non-Banking{s}Financial{s}Compan(?:ies|y)){n80}(?:Regulation|Direction)s?,?{s}{y}",
    r"Basel{s}(?:I{{1,3}}|IV)(?:{s}framework)?|Basel{s}Committee{s}on{s}Banking{s}Supervision",
    r"(?:Master{s}Directions?{s}[–-]{s})?Know{s}Your{s}Customer(?:{s}\(KYC\))?(?:{s}Directions?,?{s}{y})?",
    r"(?:RBI)?{z}Cyber{z}Security{z}Framework(?:{s}for{s}[ A-Za-z]+)?(?:,{s}{y})?",
    r"IRAC{s}norms|Prudential{s}Norms{s}on{s}Income{s}Recognition|Income{s}Recognition(?:,{s}Asset{s}Classification)?",
    r"A\.P\.{z}\(DIR{s}Series\){s}Circular{s}No\.{z}\d+",
]
REFERENCE_PARTS = {
    "s": r"\s+",
    "z": r"\s*",
    "y": r"\d{4}",
    "n80": r"[^.;,]{0,80}",
    "n50": r"[^.;,]{0,50}",
    "title": r"[ ,()A-Za-z]+(?:,\s+\d{4})?",
    "act": r"\s+Act,?\s+\d{4}",
    "sec": r"Section\s+\d+[A-Z]?\s+of\s+the\s+",
}

#: Circular and reference numbers: field; expression, with the parts above
NUMBERS = [
    ("circular_number", r"RBI/{y}-\d{{2,4}}/\d+"),
    ("reference_number", r"DOR\.[.A-Z]+\.REC\.\d+/\d\d\.\d+/{y}-\d\d"),
    ("reference_number", r"(?:CEPD|DBS|DCM|DEPR|DIT|DNB[RS]|DOS|DPSS|DR[GM]|DRRR|FED|FEMA|FEPD|FMRD|IDMD)\.[.A-Za-z]+\.[.A-Za-z]+\.\d+/\d\d\.\d+/{y}-\d\d"),
    ("circular_number", r"A\.P\.{z}\(DIR{z}Series\){z}Circular{s}No\.{z}\d+"),
    ("circular_number", r"FEMA{s}\d+(?:\([A-Z]+\))?/{y}-RB"),
    ("master_direction", r"Master{s}Direction{s}[–-]{s}[ A-Za-z]+(?:,{s}{y})?"),
    ("master_circular", r"Master{s}Circular{s}(?:on|[–-]){s}[ ,A-Za-z]+(?:,{s}{y})?"),
    ("circular_number", r"Notification{s}No\.{z}[.A-Z]+\d+/{y}"),
]

#: pattern id; type; regulator; domain; value; confidence; text
PATTERN_LIBRARY = [
    ("obligation_reporting_001", "reporting_pattern", "ANY", "ReportingAudit", "mandatory_reporting", 0.9, "shall submit report return statement in prescribed format"),
    ("deadline_relative_001", "deadline_phrase", "ANY", None, "relative_deadline", 0.88, "within number days from date event"),
    ("quote_reference_001", "quoted_text_pattern", "ANY", None, "quoted_reference", 0.92, "provides as under reads as follows is reproduced below existing regulations provide"),
]

EVIDENCE = """
KYC_AML: Updated KYC/AML procedure + Customer due diligence records
Cybersecurity: Incident response log + Security control evidence
DataPrivacy: Data handling SOP + Record retention evidence
FinancialInclusion: Branch service continuity note + Customer communication
BusinessContinuity: BCP activation record + Branch restoration tracker
FraudManagement: Fraud monitoring report + Exception handling log
CapitalAdequacy: Capital computation sheet + Regulatory reporting extract
Payments: ATM uptime report + Alternate service arrangement log
CustomerService: Fee waiver approval + Customer service advisory
Governance: Board note or approval + Updated governance policy
ITInfrastructure: System configuration evidence + Service deployment log
ReportingAudit: Submission acknowledgement + Audit trail or return copy
HR_Training: Training completion records + Updated staff guidance
FEMA: Regulatory filing + Treasury compliance record
Other: Compliance confirmation + Supporting internal record
"""
