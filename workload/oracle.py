"""The registered queries as SQL over the same tables, written independently of the DataFrame code.

``CTES`` names reusable steps; ``sql`` prefixes a query with all of them (unused ones cost nothing).
"""

from __future__ import annotations

CTES: dict[str, str] = {
    "markers": """
        SELECT 'm' || p_partkey AS marker_id, 'Gm' || lpad(CAST(1 + p_partkey % 20 AS VARCHAR), 2, '0') AS chrom,
               (p_partkey // 20 + 1) * 30000 AS pos_bp, (p_partkey // 20 + 1) * CAST(0.075 AS DOUBLE) AS cm, p_partkey AS p
        FROM part""",
    "samples": """
        SELECT 's' || s_suppkey AS sample_id, s_name AS line_name,
               CASE s_suppkey WHEN 0 THEN 'recurrent_parent' WHEN 1 THEN 'donor_parent'
                    ELSE CASE WHEN s_suppkey % 5 = 0 THEN 'candidate' ELSE 'progeny' END END AS role,
               CASE WHEN s_suppkey < 2 THEN NULL WHEN s_suppkey % 16 = 7 THEN 'line' WHEN s_suppkey % 16 = 15 THEN NULL
                    WHEN s_suppkey % 8 = 0 THEN 'BC1F1' WHEN s_suppkey % 8 = 1 THEN 'BC2F1' WHEN s_suppkey % 8 = 2 THEN 'BC2F2'
                    WHEN s_suppkey % 8 = 3 THEN 'RP*3/D' WHEN s_suppkey % 8 = 4 THEN 'BC1F1' WHEN s_suppkey % 8 = 5 THEN 'BC2S1'
                    WHEN s_suppkey % 8 = 6 THEN 'BC3F1' ELSE 'F2' END AS generation,
               CASE WHEN s_suppkey < 2 OR s_nationkey = 24 THEN NULL ELSE 'F' || s_nationkey END AS family_id,
               CASE WHEN s_acctbal < 0 THEN 'overdrawn, see ledger' END AS notes, s_suppkey AS s
        FROM supplier""",
    "progeny": "SELECT * FROM samples WHERE role IN ('progeny', 'candidate')",
    "parents": """
        SELECT 'm' || p_partkey AS marker_id, p_partkey AS p,
               CASE WHEN p_partkey % 61 = 5 THEN NULL WHEN p_partkey % 59 = 11 THEN 0 ELSE p_partkey % 2 END AS rp1,
               CASE WHEN p_partkey % 61 = 5 THEN NULL WHEN p_partkey % 59 = 11 THEN 1 ELSE p_partkey % 2 END AS rp2,
               CASE WHEN p_partkey % 53 = 7 THEN NULL WHEN p_partkey % 67 = 13 THEN 0
                    WHEN p_partkey % 17 = 3 THEN p_partkey % 2 ELSE 1 - p_partkey % 2 END AS dp1,
               CASE WHEN p_partkey % 53 = 7 THEN NULL WHEN p_partkey % 67 = 13 THEN 1
                    WHEN p_partkey % 17 = 3 THEN p_partkey % 2 ELSE 1 - p_partkey % 2 END AS dp2
        FROM part""",
    "cells": """
        SELECT l_partkey AS p, l_suppkey AS s, bool_or(l_returnflag = 'R' AND l_linenumber = 7) AS dropped,
               bool_or(l_returnflag = 'A' AND l_linenumber = 1 AND l_quantity <= 2) AS half, bool_or(l_quantity = 50) AS odd
        FROM lineitem WHERE l_suppkey >= 2 GROUP BY l_partkey, l_suppkey""",
    "haplotypes": """
        SELECT *, CASE WHEN s % 9 = 0 AND odd THEN 'X' WHEN h < 4 THEN 'H' WHEN h = 4 AND s % 4 = 2 THEN 'B' ELSE 'A' END AS made
        FROM (SELECT *, ((p % 20) * 7 + ((p // 20) // 10) * 13 + g * 29 + (g // 7) * 3) % 16 AS h
              FROM (SELECT *, CASE WHEN s % 10 = 4 THEN s - 1 ELSE s END AS g FROM cells))""",
    "progeny_calls": """
        SELECT 'm' || p AS marker_id, 's' || s AS sample_id, p, s,
               CASE WHEN dropped THEN NULL WHEN made = 'H' THEN 0 WHEN made = 'B' THEN 1 - p % 2 ELSE p % 2 END AS a1,
               CASE WHEN dropped OR half THEN NULL WHEN made = 'X' THEN 2 WHEN made = 'H' THEN 1
                    WHEN made = 'B' THEN 1 - p % 2 ELSE p % 2 END AS a2
        FROM haplotypes""",
    "calls": """
        SELECT marker_id, sample_id, a1, a2 FROM progeny_calls
        UNION ALL SELECT marker_id, 's0', rp1, rp2 FROM parents
        UNION ALL SELECT marker_id, 's1', dp1, dp2 FROM parents""",
    "classified": """
        SELECT m.*, rp1, rp2, dp1, dp2, reason IS NULL AS informative, reason
        FROM markers m JOIN (
            SELECT *, CASE WHEN rp1 IS NULL OR rp2 IS NULL THEN 'recurrent parent missing'
                           WHEN dp1 IS NULL OR dp2 IS NULL THEN 'donor parent missing'
                           WHEN rp1 <> rp2 THEN 'recurrent parent heterozygous'
                           WHEN dp1 <> dp2 THEN 'donor parent heterozygous'
                           WHEN rp1 = dp1 THEN 'parents identical (monomorphic)' END AS reason
            FROM parents) USING (marker_id, p)""",
    "reference_lengths": """
        SELECT 'Gm' || lpad(CAST(i AS VARCHAR), 2, '0') AS chrom, CAST(l[i] AS BIGINT) AS length_bp
        FROM (SELECT [57932356, 50400359, 46951867, 51203390, 42274531, 50945865, 44949257, 47227185, 50572669, 51638688,
                      39643746, 41531200, 45225049, 49893279, 53754296, 38112071, 41740657, 58286271, 51272881, 47846027] AS l),
             range(1, 21) AS r(i)""",
    "ends": """
        SELECT chrom, max(pos_bp) AS last_bp, max(cm) AS last_cm, any_value(length_bp) AS length_bp,
               max(pos_bp) <= any_value(length_bp) AS placed,
               CASE WHEN max(pos_bp) <= any_value(length_bp) THEN any_value(length_bp) ELSE max(pos_bp) END AS end_bp
        FROM markers LEFT JOIN reference_lengths USING (chrom) GROUP BY chrom""",
    "weights_bp": """
        SELECT marker_id, greatest(lft, 0) + greatest(rgt, 0) AS w2 FROM (
            SELECT marker_id,
                   least(coalesce(pos_bp - lag(pos_bp) OVER q, 2 * pos_bp), 2000000) AS lft,
                   least(coalesce(lead(pos_bp) OVER q - pos_bp, CASE WHEN placed THEN 2 * (end_bp - pos_bp) ELSE 2000000 END), 2000000) AS rgt
            FROM classified JOIN ends USING (chrom) WHERE informative
            WINDOW q AS (PARTITION BY chrom ORDER BY pos_bp, p))""",
    "weights_cm": """
        SELECT marker_id, greatest(lft, 0) + greatest(rgt, 0) AS w2 FROM (
            SELECT marker_id, least(coalesce(cm - lag(cm) OVER q, 10.0), 10.0) AS lft, least(coalesce(lead(cm) OVER q - cm, 10.0), 10.0) AS rgt
            FROM classified WHERE informative
            WINDOW q AS (PARTITION BY chrom ORDER BY pos_bp, p))""",
    "states": """
        SELECT c.*, m.chrom, m.pos_bp, m.cm, m.rp1, m.rp2, m.dp1, m.dp2, informative, coalesce(w2, 0) AS w2,
               CASE WHEN NOT informative THEN 5 WHEN a1 IS NULL OR a2 IS NULL THEN 4 WHEN a1 = rp1 AND a2 = rp1 THEN 0
                    WHEN a1 = dp1 AND a2 = dp1 THEN 2
                    WHEN (a1 = rp1 AND a2 = dp1) OR (a1 = dp1 AND a2 = rp1) THEN 1 ELSE 3 END AS state
        FROM progeny_calls c JOIN classified m USING (marker_id, p) LEFT JOIN weights_bp USING (marker_id)""",
    "shared": """
        SELECT *, CASE WHEN (a1 = rp1 AND a2 = rp2) OR (a1 = rp2 AND a2 = rp1) THEN 2
                       WHEN a1 = rp1 OR a1 = rp2 OR a2 = rp1 OR a2 = rp2 THEN 1
                       WHEN a1 IS NOT NULL AND a2 IS NOT NULL AND rp1 IS NOT NULL THEN 0 END AS sh_rp,
                  CASE WHEN (a1 = dp1 AND a2 = dp2) OR (a1 = dp2 AND a2 = dp1) THEN 2
                       WHEN a1 = dp1 OR a1 = dp2 OR a2 = dp1 OR a2 = dp2 THEN 1
                       WHEN a1 IS NOT NULL AND a2 IS NOT NULL AND dp1 IS NOT NULL THEN 0 END AS sh_dp,
               a1 IS NOT NULL AND a2 IS NOT NULL AND rp1 IS NOT NULL AS in_rp, a1 IS NOT NULL AND a2 IS NOT NULL AND dp1 IS NOT NULL AS in_dp
        FROM states""",
    "sums": """
        SELECT sample_id, count(*) FILTER (a1 IS NOT NULL AND a2 IS NOT NULL) AS n_called,
               count(*) FILTER (state = 0) AS n_a, count(*) FILTER (state = 1) AS n_h, count(*) FILTER (state = 2) AS n_b,
               count(*) FILTER (state = 3) AS n_x,
               sum(w2 * (2 - state)) FILTER (state <= 2) AS num, sum(2 * w2) FILTER (state <= 2) AS den,
               sum(w2 * (2 - state)) FILTER (state <= 2 AND chrom IN ('Gm05', 'Gm12', 'Gm07')) AS num_c,
               sum(2 * w2) FILTER (state <= 2 AND chrom IN ('Gm05', 'Gm12', 'Gm07')) AS den_c,
               sum(w2 * (2 - state)) FILTER (state <= 2 AND chrom NOT IN ('Gm05', 'Gm12', 'Gm07')) AS num_n,
               sum(2 * w2) FILTER (state <= 2 AND chrom NOT IN ('Gm05', 'Gm12', 'Gm07')) AS den_n,
               sum(sh_rp) FILTER (in_rp) AS s_rp, count(*) FILTER (in_rp) AS c_rp,
               sum(sh_dp) FILTER (in_dp) AS s_dp, count(*) FILTER (in_dp) AS c_dp
        FROM shared GROUP BY sample_id""",
    "generations": """
        SELECT *, CASE WHEN std AND filial >= 1 THEN bc WHEN NOT std AND dose >= 1 THEN dose - 1 END AS n_bc,
                  CASE WHEN std AND filial >= 1 THEN filial WHEN NOT std AND dose >= 1 THEN 1 END AS n_filial,
                  CASE WHEN std AND filial >= 1 THEN true WHEN NOT std AND dose >= 1 THEN false END AS known
        FROM (SELECT *, coalesce(try_cast(nullif(b, '') AS INT), 0) AS bc,
                     coalesce(try_cast(nullif(f, '') AS INT) + CASE WHEN generation ILIKE '%S%' AND generation NOT ILIKE '%F%' THEN 1 ELSE 0 END, 1) AS filial,
                     b <> '' OR f <> '' AS std,
                     coalesce(try_cast(nullif(regexp_extract(generation, '^\\s*[^/*\\s]+\\*([0-9]+)/[^/*\\s]+\\s*$', 1), '') AS INT),
                              try_cast(nullif(regexp_extract(generation, '^\\s*([0-9]+)\\*[^/*\\s]+/[^/*\\s]+\\s*$', 1), '') AS INT),
                              try_cast(nullif(regexp_extract(generation, '^\\s*[^/*\\s]+/[^/*\\s]+\\*([0-9]+)\\s*$', 1), '') AS INT),
                              try_cast(nullif(regexp_extract(generation, '^\\s*[^/*\\s]+/([0-9]+)\\*[^/*\\s]+\\s*$', 1), '') AS INT)) AS dose
              FROM (SELECT *, regexp_extract(generation, '^\\s*(?:BC([0-9]+))?\\s*(?:[FS]([0-9]+))?\\s*$', 1, 'i') AS b,
                           regexp_extract(generation, '^\\s*(?:BC([0-9]+))?\\s*(?:[FS]([0-9]+))?\\s*$', 2, 'i') AS f FROM progeny))""",
    "metrics": """
        SELECT g.*, num / nullif(den, 0) AS rpp_total, num_c / nullif(den_c, 0) AS rpp_carrier, num_n / nullif(den_n, 0) AS rpp_noncarrier,
               ((SELECT count(*) FROM part) - coalesce(n_called, 0)) / (SELECT count(*) FROM part) AS missing_rate,
               n_h / nullif(n_a + n_h + n_b, 0) AS het_rate, n_b / nullif(n_a + n_h + n_b, 0) AS hom_donor_rate,
               n_x / nullif(n_a + n_h + n_b + n_x, 0) AS nonparental_rate,
               coalesce(n_a + n_h + n_b, 0) AS n_informative_called,
               coalesce(n_a, 0) / greatest(coalesce(n_a + n_h + n_b, 0), 1) AS frac_a,
               coalesce(n_h, 0) / greatest(coalesce(n_a + n_h + n_b, 0), 1) AS frac_h,
               coalesce(n_b, 0) / greatest(coalesce(n_a + n_h + n_b, 0), 1) AS frac_b,
               s_rp / nullif(2 * c_rp, 0) AS ibs_rp, s_dp / nullif(2 * c_dp, 0) AS ibs_donor,
               1 - pow(0.5, n_bc) * pow(0.5, greatest(n_filial - 1, 0))
                 - (pow(0.5, n_bc) - pow(0.5, n_bc) * pow(0.5, greatest(n_filial - 1, 0))) / 2
                 + pow(0.5, n_bc) * pow(0.5, greatest(n_filial - 1, 0)) / 2 AS expected_rpp,
               CASE WHEN known THEN pow(0.5, n_bc) * pow(0.5, greatest(n_filial - 1, 0)) END AS expected_het
        FROM generations g LEFT JOIN sums USING (sample_id)""",
    "loci": """
        SELECT * FROM (VALUES ('T1', 'target', 0, 'Gm05', 60000, 900000, 'any', 1, 480000, 60000, NULL),
                              ('T2', 'target', 1, 'Gm12', 90000, 1500000, 'run', 1, 180000, NULL, NULL),
                              ('T3', 'target', 2, 'Gm07', 90000, 210000, 'all', 2, 150000, NULL, NULL),
                              ('V1', 'avoid', 3, 'Gm10', 60000, 300000, 'all', 1, 180000, NULL, NULL),
                              ('V2', 'avoid', 4, 'Gm06', 90000, 90000, 'all', 1, 90000, NULL, NULL))
               AS t(locus_id, section, ord, chrom, start_bp, end_bp, rule, min_markers, anchor_bp, fl, fr)""",
    "members": """
        SELECT locus_id, marker_id, m.pos_bp, m.p FROM loci l JOIN markers m ON m.chrom = l.chrom
        WHERE (locus_id IN ('T1', 'T2', 'V1') AND m.pos_bp BETWEEN start_bp AND end_bp)
           OR (locus_id = 'T3' AND marker_id IN ('m46', 'm126')) OR (locus_id = 'V2' AND marker_id = 'm45')""",
    "member_calls": """
        SELECT s.sample_id, l.locus_id, l.rule, l.anchor_bp, e.pos_bp, e.p, s.state,
               CASE WHEN l.section = 'target' THEN s.state IN (1, 2) WHEN l.locus_id = 'V1' THEN s.state = 0 ELSE s.state IN (0, 1) END AS sat
        FROM states s JOIN members e USING (marker_id) JOIN loci l USING (locus_id) WHERE s.state <= 2""",
    "run_rows": """
        SELECT *, row_number() OVER q AS k, sat OR coalesce(lag(sat) OVER q AND lead(sat) OVER q, false) AS joined
        FROM member_calls WHERE rule = 'run' WINDOW q AS (PARTITION BY sample_id, locus_id ORDER BY pos_bp, p)""",
    "run_islands": """
        SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY sample_id, locus_id ORDER BY k) AS island FROM run_rows""",
    "run_anchor": """
        SELECT sample_id, locus_id, max(k) FILTER (pos_bp <= anchor_bp) AS a, min(k) FILTER (pos_bp >= anchor_bp) AS b
        FROM run_rows GROUP BY sample_id, locus_id""",
    "runs": """
        SELECT r.sample_id, r.locus_id,
               count(DISTINCT island) FILTER (k BETWEEN least(a, b) AND greatest(a, b)) = 1
                 AND bool_and(joined) FILTER (k BETWEEN least(a, b) AND greatest(a, b)) AND a IS NOT NULL AND b IS NOT NULL AS anchored,
               any_value(island) FILTER (k = least(a, b)) AS island
        FROM run_islands r JOIN run_anchor USING (sample_id, locus_id) GROUP BY r.sample_id, r.locus_id, a, b""",
    "run_lengths": """
        SELECT u.sample_id, u.locus_id, anchored AND count(*) FILTER (sat AND joined) >= 2 AS run_ok
        FROM runs u JOIN run_islands i ON i.sample_id = u.sample_id AND i.locus_id = u.locus_id AND i.island = u.island
        GROUP BY u.sample_id, u.locus_id, anchored""",
    "counted": """
        SELECT sample_id, locus_id, count(*) AS n_counted, count(*) FILTER (sat) AS n_satisfied FROM member_calls GROUP BY sample_id, locus_id""",
    "status": """
        SELECT g.sample_id, l.locus_id, l.section, l.ord, coalesce(n_counted, 0) AS n_counted, coalesce(n_satisfied, 0) AS n_satisfied,
               CASE WHEN coalesce(n_counted, 0) < min_markers THEN 'unknown'
                    WHEN rule = 'all' AND n_counted = n_satisfied THEN 'pass' WHEN rule = 'any' AND n_satisfied >= 1 THEN 'pass'
                    WHEN rule = 'run' AND coalesce(run_ok, false) THEN 'pass' ELSE 'fail' END AS status
        FROM progeny g CROSS JOIN loci l LEFT JOIN counted c ON c.sample_id = g.sample_id AND c.locus_id = l.locus_id
             LEFT JOIN run_lengths r ON r.sample_id = g.sample_id AND r.locus_id = l.locus_id""",
    "walk": """
        SELECT s.sample_id, l.locus_id, s.state, CASE WHEN s.pos_bp < start_bp THEN 'L' ELSE 'R' END AS side,
               CASE WHEN s.pos_bp < start_bp THEN start_bp - s.pos_bp ELSE s.pos_bp - end_bp END AS d
        FROM states s JOIN loci l ON l.section = 'target' AND l.chrom = s.chrom AND (s.pos_bp < start_bp OR s.pos_bp > end_bp)
        WHERE s.state <= 2""",
    "first_a": "SELECT sample_id, locus_id, side, min(d) AS d_a FROM walk WHERE state = 0 GROUP BY sample_id, locus_id, side",
    "last_donor": """
        SELECT w.sample_id, w.locus_id, w.side, max(w.d) AS d_d FROM walk w LEFT JOIN first_a f USING (sample_id, locus_id, side)
        WHERE w.state IN (1, 2) AND (f.d_a IS NULL OR w.d < f.d_a) GROUP BY w.sample_id, w.locus_id, w.side""",
    "drag": """
        SELECT *, CAST(left_min + right_min + left_max + right_max AS DOUBLE) / 2 AS total_est, left_max + right_max AS total_max,
               left_min + right_min AS total_min, left_max <= coalesce(fl, 200000) AS recombinant_left, right_max <= coalesce(fr, 200000) AS recombinant_right
        FROM (SELECT g.sample_id, l.locus_id, l.ord, e.end_bp AS far_end, l.fl, l.fr,
                     coalesce(dl.d_d, 0) AS left_min, coalesce(al.d_a, l.start_bp) AS left_max,
                     coalesce(dr.d_d, 0) AS right_min, coalesce(ar.d_a, greatest(e.end_bp - l.end_bp, 0)) AS right_max
              FROM progeny g CROSS JOIN (SELECT * FROM loci WHERE section = 'target') l JOIN ends e ON e.chrom = l.chrom
                   LEFT JOIN first_a al ON al.sample_id = g.sample_id AND al.locus_id = l.locus_id AND al.side = 'L'
                   LEFT JOIN first_a ar ON ar.sample_id = g.sample_id AND ar.locus_id = l.locus_id AND ar.side = 'R'
                   LEFT JOIN last_donor dl ON dl.sample_id = g.sample_id AND dl.locus_id = l.locus_id AND dl.side = 'L'
                   LEFT JOIN last_donor dr ON dr.sample_id = g.sample_id AND dr.locus_id = l.locus_id AND dr.side = 'R')""",
    "drag_sums": """
        SELECT sample_id, sum(total_est) AS drag_total_est, sum(total_max) AS drag_total_max,
               sum(CAST(recombinant_left AS INT) + CAST(recombinant_right AS INT)) AS recombinant_flanks,
               1 - (max(share) FILTER (ord = 0) + max(share) FILTER (ord = 1) + max(share) FILTER (ord = 2)) / 3 AS drag,
               sum(CAST(recombinant_left AS INT) + CAST(recombinant_right AS INT)) / 6 AS recombinant
        FROM (SELECT *, CASE WHEN far_end > 0 THEN least(greatest(total_est / far_end, 0.0), 1.0) ELSE 1.0 END AS share FROM drag)
        GROUP BY sample_id""",
    "shares": """
        SELECT sample_id, coalesce(family_id, '') AS family, hom_donor_rate + het_rate / 2 AS donor
        FROM metrics WHERE missing_rate <= 0.98 AND het_rate IS NOT NULL""",
    "centres": "SELECT family, median(donor) AS centre FROM shares GROUP BY family HAVING count(*) >= 6",
    "spreads": "SELECT family, centre, median(abs(donor - centre)) AS mad FROM shares JOIN centres USING (family) GROUP BY family, centre",
    "outliers": """
        SELECT sample_id FROM shares JOIN spreads USING (family) WHERE donor > centre + 2.5 * greatest(1.4826 * mad, 0.01)""",
    "pool": "SELECT marker_id FROM classified WHERE informative",
    "called": """
        SELECT marker_id, sample_id, s, least(a1, a2) AS x, greatest(a1, a2) AS y FROM progeny_calls JOIN pool USING (marker_id)
        WHERE a1 IS NOT NULL AND a2 IS NOT NULL""",
    "pairs": """
        SELECT a.sample_id AS sample_a, b.sample_id AS sample_b, count(*) AS n_overlap,
               sum(CASE WHEN a.x = b.x AND a.y = b.y THEN 2 WHEN a.x = b.x OR a.x = b.y OR a.y = b.x OR a.y = b.y THEN 1 ELSE 0 END) AS n_shared
        FROM called a JOIN called b ON a.marker_id = b.marker_id AND a.s < b.s GROUP BY a.sample_id, b.sample_id""",
    "pair_floor": "SELECT greatest(1, ceil(CAST(0.001 AS DOUBLE) * count(*))) AS n FROM pool",
    "duplicate_pairs": "SELECT * FROM pairs WHERE n_overlap >= (SELECT n FROM pair_floor) AND n_shared / (2 * n_overlap) >= 0.995",
    "duplicate_members": "SELECT sample_a AS sample_id FROM duplicate_pairs UNION SELECT sample_b FROM duplicate_pairs",
    "flagged": """
        SELECT m.*, concat_ws('|', CASE WHEN missing_rate > 0.98 THEN 'high_missing' END,
                   CASE WHEN n_bc IS NULL AND generation <> '' THEN 'generation_unparsed' END,
                   CASE WHEN n_informative_called > 0 AND known AND n_filial = 1 AND n_bc >= 1 AND hom_donor_rate > 0.08 THEN 'possible_self_or_outcross' END,
                   CASE WHEN n_informative_called > 0 AND abs(het_rate - expected_het) > 0.15 THEN 'het_rate_deviates' END,
                   CASE WHEN n_informative_called > 0 AND nonparental_rate > 0.02 THEN 'possible_outcross' END,
                   CASE WHEN n_informative_called > 0 AND ibs_rp > 0.995 AND het_rate < 0.005 THEN 'possible_rp_sample' END,
                   CASE WHEN n_informative_called > 0 AND ibs_donor > 0.995 AND het_rate < 0.005 THEN 'possible_donor_sample' END,
                   CASE WHEN sample_id IN (SELECT sample_id FROM outliers) THEN 'family_donor_outlier' END,
                   CASE WHEN sample_id IN (SELECT sample_id FROM duplicate_members) THEN 'possible_duplicate' END) AS qc_flags,
               concat_ws('|', CASE WHEN n_informative_called > 0 AND known AND n_filial = 1 AND n_bc >= 1 AND hom_donor_rate > 0.08 THEN 'possible_self_or_outcross' END,
                   CASE WHEN n_informative_called > 0 AND nonparental_rate > 0.02 THEN 'possible_outcross' END,
                   CASE WHEN n_informative_called > 0 AND ibs_rp > 0.995 AND het_rate < 0.005 THEN 'possible_rp_sample' END,
                   CASE WHEN n_informative_called > 0 AND ibs_donor > 0.995 AND het_rate < 0.005 THEN 'possible_donor_sample' END) AS excluding
        FROM metrics m""",
    "reasons": """
        SELECT sample_id, string_agg(section || ':' || locus_id || ':' || status, ';' ORDER BY ord) FILTER (status = 'fail') AS text,
               bool_and(status = 'pass') FILTER (section = 'target') AS foreground_all_pass,
               bool_and(status = 'pass') FILTER (section = 'avoid') AS avoid_all_pass
        FROM status GROUP BY sample_id""",
    "scored": """
        SELECT *, exclusion_reason = '' AS passes_filters,
               (0.0 + coalesce(0.5e0 * coalesce(rpp_noncarrier, rpp_total), 0) + coalesce(0.2e0 * rpp_carrier, 0) + 0.2e0 * drag + 0.1e0 * recombinant)
                 / (0.0 + CASE WHEN coalesce(rpp_noncarrier, rpp_total) IS NOT NULL THEN 0.5e0 ELSE 0 END
                        + CASE WHEN rpp_carrier IS NOT NULL THEN 0.2e0 ELSE 0 END + 0.2e0 + 0.1e0) AS composite_score
        FROM (SELECT *, concat_ws(';', text, CASE WHEN missing_rate > 0.98 THEN 'missing_rate>0.98' END,
                                  CASE WHEN excluding <> '' THEN 'qc:' || excluding END) AS exclusion_reason
              FROM flagged JOIN reasons USING (sample_id) JOIN drag_sums USING (sample_id))""",
    "ranked": """
        SELECT s.*, o.r AS rank_overall, o.f AS rank_in_family FROM scored s LEFT JOIN (
            SELECT sample_id, row_number() OVER (ORDER BY composite_score DESC NULLS LAST, rpp_total DESC NULLS LAST, drag_total_est NULLS LAST,
                                                 missing_rate NULLS LAST, sample_id) AS r,
                   row_number() OVER (PARTITION BY coalesce(family_id, '') ORDER BY composite_score DESC NULLS LAST, rpp_total DESC NULLS LAST,
                                      drag_total_est NULLS LAST, missing_rate NULLS LAST, sample_id) AS f
            FROM scored WHERE passes_filters) o USING (sample_id)""",
}


def sql(query: str) -> str:
    """The query behind every step it may name; a query that starts with a comma adds steps of its own."""
    steps = ",\n".join(f"{name} AS ({body})" for name, body in CTES.items())
    return f"WITH RECURSIVE {steps}\n{query.strip()}"
