"""DuckDB twins of the queries: written apart from the operators they check."""

from __future__ import annotations

import hashlib
import hmac
import re

from .derived import MASTER, OPENINGS


def _pads(key: bytes) -> tuple[str, str]:
    padded = key.ljust(64, b"\0")
    return (
        bytes(b ^ 0x36 for b in padded).hex(),
        bytes(b ^ 0x5C for b in padded).hex(),
    )


def _hmac(message: str, key: bytes) -> str:
    inner, outer = _pads(key)
    return (
        f"sha256(unhex('{outer}')||unhex(sha256(unhex('{inner}')||encode({message}))))"
    )


def _uuid(m: str) -> str:
    return (
        f"substr({m},1,8)||'-'||substr({m},9,4)||'-'||substr({m},13,4)||'-'"
        f"||substr({m},17,4)||'-'||substr({m},21,12)"
    )


def _u64(hex_text: str) -> str:
    return f"('0x'||{hex_text})::UBIGINT"


def _i64(hex_text: str) -> str:
    u = f"{_u64(hex_text)}::HUGEINT"
    return f"(case when {u} >= 9223372036854775808 then {u} - 18446744073709551616 else {u} end)::BIGINT"


def _hamming(a: str, b: str) -> str:
    return f"bit_count(xor({_u64(a)}, {_u64(b)}))::INT"


def _key(purpose: str, size: int = 32) -> bytes:
    """Sub-key by its definition: HMAC of the purpose, then of it with counters behind."""
    message = b"hallmark/v1/" + purpose.encode()
    key, counter = hmac.digest(MASTER, message, "sha256"), 0
    while len(key) < size:
        counter += 1
        key += hmac.digest(MASTER, message + counter.to_bytes(4, "big"), "sha256")
    return key[:size]


def _parity_words(position: int, bit: int) -> list[int]:
    """Parity of the payload with one bit set, as four words: long division by the
    polynomial with roots 1, a, ..., a^31 over GF(256), by logarithms."""
    exp = [1]
    while len(exp) < 255:
        exp.append(exp[-1] << 1 ^ (0x11D if exp[-1] & 0x80 else 0))
    log = {x: k for k, x in enumerate(exp)}

    def times(a: int, b: int) -> int:
        return exp[(log[a] + log[b]) % 255] if a and b else 0

    divisor = [1]
    for k in range(32):
        divisor = [a ^ times(b, exp[k]) for a, b in zip([*divisor, 0], [0, *divisor])]
    rest = [0] * 48
    rest[position] = 0x80 >> bit
    for at in range(16):
        lead = rest[at]
        for k, d in enumerate(divisor):
            rest[at + k] ^= times(lead, d)
    return [int.from_bytes(bytes(rest[16 + 8 * w : 24 + 8 * w]), "big") for w in range(4)]


def _commitments() -> str:
    """(k, value, randomness, commitment) of the openings, by plain powers."""
    prime = int(
        # fixed value: RFC 3526 group 14
        "FFFFFFFFFFFFFFFFC90FDAA22168C234C4C6628B80DC1CD129024E088A67CC74020BBEA63B139B22"
        "514A08798E3404DDEF9519B3CD3A431B302B0A6DF25F14374FE1356D6D51C245E485B576625E7EC6"
        "F44C42E9A637ED6B0BFF5CB6F406B7EDEE386BFB5A899FA5AE9F24117C4B1FE649286651ECE45B3D"
        "C2007CB8A163BF0598DA48361C55D39A69163FA8FD24CF5F83655D23DCA3AD961C62F356208552BB"
        "9ED529077096966D670C354E4ABC9804F1746C08CA18217C32905E462E36CE3BE39E772C180E8603"
        "9B2783A2EC07A28FB5C55DF06F4C52C9DE2BCBF6955817183995497CEA956AE515D2261898FA0510"
        "15728E5A8AACAA68FFFFFFFFFFFFFFFF",
        16,
    )
    order = (prime - 1) // 2
    secret = int.from_bytes(_key("pedersen/h/v1", 64), "big") % order or 1
    h = pow(2, secret, prime)
    rows = [(k, v, r, pow(2, v, prime) * pow(h, r, prime) % prime) for k, (v, r) in enumerate(OPENINGS)]
    return ",".join(f"({k},'{v}','{r}','{c:x}')" for k, v, r, c in rows)


_PAYLOAD_KEY = _key("watermark/payload/v1")
_CHALLENGE_KEY = _key("challenge")
_ISO = "%Y-%m-%dT%H:%M:%S.%f"

# Parity as a linear map over bits: for each payload bit, the four words it flips.
_PARITY_ROWS = ",".join(
    "({},{},{},{},{})".format(
        8 * position + bit,
        *_parity_words(position, bit),
    )
    for position in range(16)
    for bit in range(8)
)

_CTES = {
    "claims0": f"""
      select o_orderkey ok,
        'acct-'||o_custkey account_id, 'dev-'||(o_orderkey%7) device_signature,
        o_orderdate + to_seconds(o_orderkey) creation_timestamp,
        o_orderdate + to_seconds(o_orderkey + o_orderkey%3600) created_at,
        sha256('hash|'||o_orderkey) h, md5('asset|'||o_orderkey) m,
        md5('m|'||o_orderkey) mu,
        sha256('c|'||o_orderkey) zkp_commitment_hex
      from orders""",
    "ledger": f"""
      select *, sha256(concat_ws('|', payload_hex, zkp_commitment_hex, phash, dhash, ahash,
          whash, strftime(creation_timestamp, '{_ISO}'), account_id)) chain_of_custody_hash
      from (select ok, {_uuid("m")} asset_id, account_id, device_signature,
          creation_timestamp, created_at, created_at updated_at, zkp_commitment_hex,
          substr(h,1,16) phash, substr(h,17,16) dhash,
          substr(h,33,16) ahash, substr(h,49,16) whash,
          substr({_hmac("account_id||'|'||epoch_us(creation_timestamp)||'|'||device_signature", _PAYLOAD_KEY)},1,32) payload_hex,
          '04'||{_hmac("'hallmark/v1/account_pubkey/v1/'||account_id", MASTER)} account_public_key,
          mu c2pa_manifest_uuid, ok%5=0 c2pa_embedded,
          case when ok%5=0 then 'manifests/'||mu||'.c2pa'
               else 'hallmark://manifest/'||mu end c2pa_manifest_reference,
          'hallmark engine/1.0.0' generator_model_id, 'img_'||ok||'.png' original_filename,
          (1000 + ok%9000)::BIGINT file_size_bytes,
          (128 + ok%64)::INT image_width, (128 + ok%32)::INT image_height,
          case when ok%11<>0 then 38 + (ok%70)/8.0::DOUBLE end psnr_db,
          case when ok%10=0 then 'note '||ok end notes
        from claims0)""",
    "suspects": """
      select ok query_id, (ok%13)::INT flips,
        lpad(lower(to_hex(xor(('0x'||phash)::UBIGINT, ((1::UBIGINT << (ok%13)::INT) - 1)::UBIGINT))),16,'0') phash,
        case when ok%2=0 then account_id end account_id
      from ledger""",
    "versions": """
      select * exclude (ok) from ledger
      union all
      select * exclude (ok) replace (updated_at + interval 1 day as updated_at, 'v2' as notes)
      from ledger where ok%50=0""",
    "reregistered": """
      select * from ledger
      union all
      select * replace (md5('re|'||ok) as asset_id, 'acct-x' as account_id,
                        created_at + interval 1 day as created_at)
      from ledger where ok%50=0""",
    "challenges": f"""
      select *, case when event_id%11=0 then reverse(right_mac) else right_mac end mac
      from (select *, {_hmac("account_id||'|'||nonce||'|'||iat||'|'||300", _CHALLENGE_KEY)} right_mac
        from (select event_id, 'acct-'||user_id account_id,
            substr(md5('n|'||user_id||'|'||(event_id//50)),1,22) nonce,
            (epoch_us(ts)//1000000)::BIGINT iat, (epoch_us(ts)//1000000)::BIGINT + 300 "exp",
            ts + to_seconds(event_id%400) seen_at
          from events))""",
    "basis": """
      select list_transform(range(64), lambda k: list_transform(range(64), lambda p:
        (case when k//8=0 then sqrt(0.125::DOUBLE) else 0.5 end)
        * (case when k%8=0 then sqrt(0.125::DOUBLE) else 0.5 end)
        * cos(pi()*(k//8)*(2*(p//8)+1)/16) * cos(pi()*(k%8)*(2*(p%8)+1)/16))) basis_rows""",
    "blocks": """
      select vec_id::VARCHAR image_id, b::INT block_idx,
        list_transform(range(64), lambda i: ('0x'||substr(h,(2*i+1)::INT,2))::INT::DOUBLE) y
      from (select vec_id, b, sha256('b|'||vec_id||'|'||b||'|0')||sha256('b|'||vec_id||'|'||b||'|1') h
            from embeddings, range(128) t(b))""",
    "coefs": """
      select image_id, block_idx,
        list_transform(basis_rows, lambda r: list_inner_product(r, y)) coef
      from blocks, basis""",
    "features": """
      select image_id, block_idx,
        (list_sum(list_transform(coef, lambda v: abs(v))) - abs(coef[1]))/63.0 energy,
        coef[18] c0, coef[11] c1, coef[19] c2, coef[26] c3, coef[34] sync
      from coefs""",
    "gains": """
      select image_id, coalesce(median(case when abs(sync)>=1e-6 then sync/(20.0*(
          case when q%2<>0 then q when sync>0 then q+1 else q-1 end)) end), 1.0) gain
      from (select *, round_even(sync/20.0, 0)::BIGINT q from features where block_idx<4)
      group by image_id""",
    "images": """
      select vec_id::VARCHAR image_id, 128 height, (128 + 8*(vec_id%3))::INT width,
        list_transform(range((128 + 8*(vec_id%3))*12), lambda i: sha256('px|'||vec_id||'|'||i)) d
      from embeddings""",
    "luma": """
      select image_id, width, list_transform(range(128*width), lambda n:
        (299*('0x'||substr(d[((3*n+2)//32+1)::BIGINT],(2*((3*n+2)%32)+1)::INT,2))::INT
        +587*('0x'||substr(d[((3*n+1)//32+1)::BIGINT],(2*((3*n+1)%32)+1)::INT,2))::INT
        +114*('0x'||substr(d[((3*n)//32+1)::BIGINT],(2*((3*n)%32)+1)::INT,2))::INT
        +500)//1000) v
      from images""",
    "strips": """
      select image_id, width, r::INT r, list_transform(range(width), lambda x:
        v[((4*r)*width+x+1)::BIGINT] + v[((4*r+1)*width+x+1)::BIGINT]
        + v[((4*r+2)*width+x+1)::BIGINT] + v[((4*r+3)*width+x+1)::BIGINT]) s
      from luma, range(32) t(r)""",
    "squares": """
      select image_id, r, list_transform(range(32), lambda c: list_sum(list_transform(
          range((c*width//32)::BIGINT, least(((c+1)*width+31)//32, width)::BIGINT), lambda x:
          s[(x+1)::BIGINT] * (least((c+1)*width, 32*(x+1)) - greatest(c*width, 32*x))))) a,
        list_transform(range(9), lambda c: list_sum(list_transform(
          range((c*width//9)::BIGINT, least(((c+1)*width+8)//9, width)::BIGINT), lambda x:
          s[(x+1)::BIGINT] * (least((c+1)*width, 9*(x+1)) - greatest(c*width, 9*x))))) b
      from strips""",
    "image_grids": """
      select image_id, flatten(list(a order by r)) g, list(b order by r) nines
      from squares group by image_id""",
    "eights": """
      select image_id, g, nines, list_transform(range(64), lambda n: list_sum(list_transform(range(16),
        lambda j: g[((4*(n//8) + j//4)*32 + 4*(n%8) + j%4 + 1)::BIGINT]))) e
      from image_grids""",
    "vectors": """
      select vec_id, list_transform(embedding, lambda v: v::DOUBLE) e from embeddings""",
    "cells32": """
      select vec_id, list_transform(range(1024), lambda i:
        e[((i//128)*8 + (i%32)//4 + 1)::BIGINT]) g from vectors""",
    "basis32": """
      select list_transform(range(8), lambda k: list_transform(range(32), lambda p:
        (case when k=0 then sqrt(1/32::DOUBLE) else sqrt(2/32::DOUBLE) end)
        * cos(pi()*k*(2*p+1)/64))) rows32""",
    "parity_bits": f"""
      select * from (values {_PARITY_ROWS}) t(bit, w0, w1, w2, w3)""",
    "codewords": """
      select l.ok, l.payload_hex, l.payload_hex
        ||lpad(lower(to_hex(bit_xor(w0::UBIGINT))),16,'0')||lpad(lower(to_hex(bit_xor(w1::UBIGINT))),16,'0')
        ||lpad(lower(to_hex(bit_xor(w2::UBIGINT))),16,'0')||lpad(lower(to_hex(bit_xor(w3::UBIGINT))),16,'0') codeword
      from ledger l, parity_bits p
      where (('0x'||substr(payload_hex, (bit//4+1)::INT, 1))::INT >> (3 - bit%4)::INT) & 1 = 1
      group by l.ok, l.payload_hex""",
}


def _assemble(body: str) -> str:
    """Put the derived tables that `body` names in front of it."""
    body = " ".join(body.split())
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, sql in _CTES.items():
            if name not in needed and re.search(rf"(\bfrom|\bjoin|,)\s*{name}\b", text):
                visit(sql)
                needed.append(name)

    visit(body)
    tables = [f"{n} as materialized ({' '.join(_CTES[n].split())})" for n in needed]
    if re.match(r"\w+ as \(", body):  # it brings tables of its own
        return "with recursive " + ", ".join([*tables, body])
    return ("with " + ", ".join(tables) + " " if tables else "") + body


def _hash_bits(condition: str, count: int = 64) -> str:
    """Hex of 64 bits, `condition` over index i (from 0), most significant first."""
    return (
        "array_to_string(list_transform(range(16), lambda n: substr('0123456789abcdef', ("
        + "+".join(
            f"(case when {condition.replace('#', f'(4*n+{j})')} then {8 >> j} else 0 end)"
            for j in range(4)
        )
        + "+1)::INT, 1)), '')"
    )


def oracle_sql() -> dict[str, str]:
    iso = lambda c: f"strftime({c}, '{_ISO}')"
    entry = f"""asset_id, payload_hex, zkp_commitment_hex, phash, dhash, ahash, whash,
        c2pa_manifest_reference manifest_reference, c2pa_manifest_uuid manifest_uuid,
        c2pa_embedded embedded, {iso('creation_timestamp')} creation_timestamp,
        account_id, device_signature, generator_model_id, image_width, image_height,
        file_size_bytes, psnr_db, {iso('created_at')} created_at"""
    probe = "(select phash from suspects where query_id=7)"
    probe_d = "(select dhash from ledger where ok=7)"
    trigram = lambda h: (
        f"list_distinct(list_transform(range(1, length({h})+2), lambda i: substr(repeat(' ', 2)||{h}||' ', i::INT, 3)))"
    )
    similarity = lambda a, b: (
        f"(len(list_intersect({trigram(a)}, {trigram(b)}))::DOUBLE / "
        f"len(list_distinct(list_concat({trigram(a)}, {trigram(b)}))))"
    )
    bodies = {
        # --- ledger, bindings, views
        "ledger_bindings": f"""
          select ok, asset_id, payload_hex, account_public_key, chain_of_custody_hash,
            sha256(concat_ws('|', payload_hex, phash, dhash, ahash, whash, account_id)) digest,
            substr(sha256(account_id),1,16) account_hash,
            {_i64('phash')} phash64, {_i64('dhash')} dhash64,
            {_i64('ahash')} ahash64, {_i64('whash')} whash64 from ledger""",
        "entry_view": f"select {entry} from ledger",
        "public_view": f"""select {entry}, original_filename, 'image/png' content_type,
            true public_endpoint, '/api/v1/asset/'||asset_id||'/image' image_url,
            '/api/v1/asset/'||asset_id||'/thumb' thumb_url, ok%3<>0 image_available
          from ledger""",
        "get_by_id": f"select {entry} from ledger where ok=77",
        "get_by_commitment": f"select {entry} from ledger where ok=78",
        "get_by_payload": f"""select {entry} from reregistered
          where payload_hex=(select payload_hex from ledger where ok=50)""",
        "list_for_account": f"""select {entry} from ledger
          where account_id=(select min(account_id) from ledger)
          order by ledger.created_at desc, asset_id limit 5 offset 1""",
        "list_all": f"""select {entry} from ledger
          order by ledger.created_at desc, asset_id limit 50 offset 20""",
        "list_page": f"""select {entry} from ledger
          order by ledger.created_at desc, asset_id limit 50 offset 700""",
        "list_after": f"""select {entry} from ledger
          where (epoch_us(ledger.created_at), asset_id) <> (select (epoch_us(l.created_at), l.asset_id) from ledger l order by l.asset_id limit 1)
            and ledger.created_at <= (select l.created_at from ledger l order by l.asset_id limit 1)
          order by ledger.created_at desc, asset_id limit 50""",
        "current_version": """
          select asset_id, strftime(updated_at, '%Y-%m-%dT%H:%M:%S.%f') updated_at, notes from (
            select *, row_number() over (partition by asset_id order by updated_at desc) rn
            from versions) where rn=1""",
        "register": f"""
          select ok, {_uuid("digest")} asset_id, payload_hex, account_public_key,
            chain_of_custody_hash, strftime(creation_timestamp, '%Y-%m') created_month
          from (select *, sha256(concat_ws('|', payload_hex, phash, dhash, ahash, whash, account_id)) digest
                from ledger)""",
        "read_ledger_evolved": """
          select asset_id, payload_hex, case when ok%2=0 then 'img '||ok end image_text from ledger""",
        "manifest_lookup": """
          select asset_id, case when ok%5=0 then 'manifest '||ok end manifest_text from ledger""",
        "validate_queries": """
          select ok, error_code, error_code is null and hexy searchable from (
            select ok, coalesce(regexp_matches(phash, '^[0-9a-fA-F]+$'), false)
                     or coalesce(regexp_matches(dhash, '^[0-9a-fA-F]+$'), false) hexy,
              case when asset_id is not null and not regexp_matches(replace(asset_id,'-',''), '^[0-9a-fA-F]{32}$') then 'BAD_ASSET_ID'
                   when asset_id is null and coalesce(phash,'')='' and coalesce(dhash,'')='' then 'NO_HASH'
                   when length(phash) not between 8 and 64 or length(dhash) not between 8 and 64 then 'BAD_HASH_LENGTH'
                   when row_limit not between 1 and 50 then 'BAD_LIMIT'
                   when max_distance not between 0 and 64 then 'BAD_DISTANCE' end error_code
            from (select ok, case ok%6 when 0 then asset_id when 1 then 'no-'||asset_id end asset_id,
                case ok%5 when 0 then null when 1 then 'zz'||phash when 2 then substr(phash,1,6) else phash end phash,
                case ok%7 when 0 then dhash when 1 then repeat(dhash, 5) end dhash,
                (ok%60)::INT row_limit, (ok%70 - 2)::INT max_distance from ledger))""",
        "validate_images": """
          select ok, case when error_detail is not null then 'INVALID_IMAGE' end error_code, error_detail
          from (select ok, case when fb<=0 then 'empty' when fb>52428800 then 'too many bytes'
              when least(h,w)<0 then 'undecodable' when least(h,w)<128 then 'too small'
              when greatest(h,w)>4096 then 'too large' end error_detail
            from (select o_orderkey ok, case when o_orderkey%9=0 then -1 else 100 + o_orderkey%4100 end h,
                case when o_orderkey%9=0 then -1 else 120 + o_orderkey%300 end w,
                case when o_orderkey%17=0 then 0 when o_orderkey%19=0 then 60000000 else 5000 end fb from orders))""",
        "capacity_filter": """
          select o_orderkey ok from orders
          where ((20 + o_orderkey%150)//8) * ((40 + o_orderkey%90)//8) >= 100""",
        # --- scalar functions
        "hamming_hex_pairs": f"""
          select ok, {_hamming('phash','dhash')} equal_length, 96 longer, 64 shorter,
            ({_hamming('phash','dhash')} + {_hamming('ahash','whash')})::INT long_pair
          from ledger""",
        "hash_distances_any": f"""
          select ok, p, d, a, w, p<=8 or d<=6 or a<=6 or w<=7 within_any from (
            select ok, {_hamming('phash','dhash')} p, {_hamming('dhash','ahash')} d,
              {_hamming('ahash','whash')} a, {_hamming('whash','phash')} w from ledger)""",
        "trigram_similarity_pairs": f"""
          select ok, round({similarity('phash', 'dhash')}, 6) similarity from ledger""",
        "encodings": """
          select ok, rtrim(translate(to_base64(encode(account_id||'?>'||device_signature)), '+/', '-_'), '=') encoded,
            account_id||'?>'||device_signature decoded,
            case ok%4 when 0 then phash when 1 then '0'||substr(phash,1,7) when 2 then phash end parsed
          from ledger""",
        "manifest_assertions": f"""
          select ok, '{{"asset_id":"'||asset_id||'","account_id_hash":"'||substr(sha256(account_id),1,16)
            ||'","payload_hex":"'||payload_hex||'","perceptual_hashes":{{"phash":"'||phash||'","dhash":"'||dhash
            ||'","ahash":"'||ahash||'","whash":"'||whash||'"}},"device_signature":"'||device_signature
            ||'","creation_timestamp":"'||{iso('creation_timestamp')}||'+00:00","generator":{{"name":"hallmark engine","version":"1.0.0","agent_type":"watermarker"}}}}' assertion
          from ledger""",
        "qim": """
          select vec_id, i, round(20.0*(1.0+energy/100.0), 6) delta, (((q%2)+2)%2)::INT bit,
            round((q + case when (((q%2)+2)%2)<>(i%2) then 1 else 0 end)*20.0*(1.0+energy/100.0), 6) marked
          from (select *, round_even(v/(20.0*(1.0+energy/100.0)), 0)::BIGINT q from (
            select vec_id, i::INT i, c[i+1] v,
              (list_sum(list_transform(c, lambda x: abs(x))) - abs(c[1]))/63.0 energy
            from (select vec_id, list_transform(e, lambda x: x*100.0) c from vectors), range(64) t(i)))""",
        # --- search
        "search_phash": f"""
          select asset_id, distance from (select asset_id, {_hamming('phash', probe)} distance from ledger)
          where distance<=26 order by distance, asset_id limit 20""",
        "search_nearest": f"""
          select asset_id, distance from (select asset_id, {_hamming('dhash', probe_d)} distance from ledger)
          order by distance, asset_id limit 20""",
        "search_account": f"""
          select asset_id, distance from (select asset_id, {_hamming('phash', probe)} distance from ledger
            where account_id=(select account_id from ledger where ok=7))
          where distance<=40 order by distance, asset_id limit 20""",
        "search_trigram": f"""
          select asset_id, distance from (
            select asset_id, {_hamming('phash', 'wanted')} distance, {similarity('phash', 'wanted')} s
            from ledger, (select phash wanted from suspects where query_id=7))
          where distance<=30 and s>=0.3 order by distance, asset_id limit 20""",
        "search_combined": f"""
          with_p as (select asset_id, {_hamming('phash', probe)} d from ledger
              where {_hamming('phash', probe)}<=22 order by d, asset_id limit 10),
          with_d as (select asset_id, {_hamming('dhash', probe_d)} d from ledger
              where {_hamming('dhash', probe_d)}<=22 order by d, asset_id limit 10)
          select asset_id, p phash_distance, d dhash_distance, 0 ahash_distance, payload_match from (
            select coalesce(a.asset_id, b.asset_id) asset_id, coalesce(a.d, 0) p, coalesce(b.d, 0) d,
              false payload_match, case when a.asset_id is null then 1 else 0 end src, coalesce(a.d, b.d) k
            from with_p a full join with_d b on a.asset_id=b.asset_id)
          order by src, k, asset_id limit 10""",
        "radius_join": f"""
          select query_id, asset_id, bit_count(xor(x.q, y.t))::INT distance
          from (select query_id, account_id, {_u64('phash')} q from suspects) x,
               (select asset_id, account_id, {_u64('phash')} t from ledger) y
          where bit_count(xor(x.q, y.t))<=14
            and (x.account_id is null or x.account_id=y.account_id)""",
        "search_batch": f"""
          select query_id, asset_id, distance, rank::INT rank from (
            select *, row_number() over (partition by query_id order by distance, asset_id) rank from (
              select query_id, asset_id, bit_count(xor(x.q, y.t))::INT distance
              from (select query_id, {_u64('phash')} q from suspects) x,
                   (select asset_id, {_u64('phash')} t from ledger) y
              where bit_count(xor(x.q, y.t))<=16))
          where rank<=3""",
        "search_trigram_batch": f"""
          select query_id, asset_id, distance, rank::INT rank from (
            select query_id, asset_id, distance, row_number() over (partition by query_id order by distance, asset_id) rank
            from (select * from (
              select query_id, asset_id, bit_count(xor(x.q, y.t))::INT distance, x.phash a, y.phash b
              from (select query_id, phash, {_u64('phash')} q from suspects) x,
                   (select asset_id, phash, {_u64('phash')} t from ledger) y
              where bit_count(xor(x.q, y.t))<=14) where {similarity('a', 'b')}>=0.3))
          where rank<=3""",
        "nearest_match": f"""
          select query_id, case when d<=10 then idx else -1 end match_idx, d distance from (
            select query_id, min(bit_count(xor(x.q, y.t))*10000000000 + ok) best,
              (best//10000000000)::INT d, (best%10000000000)::BIGINT idx
            from (select query_id, {_u64('phash')} q from suspects) x,
                 (select ok, {_u64('phash')} t from ledger) y
            group by query_id)""",
        # --- match
        "match_payload": """
          select ok, asset_id found_id from (
            select s.ok, r.asset_id, row_number() over (partition by s.ok order by
              coalesce(s.acct=r.account_id, false) desc, r.created_at desc, r.asset_id) rn
            from (select ok, case when ok%3<>2 then payload_hex end payload_hex,
                    case ok%3 when 0 then account_id end acct from ledger) s
            left join reregistered r on s.payload_hex=r.payload_hex)
          where rn=1""",
        "encode_codewords": "select ok, payload_hex, codeword from codewords",
        "match_codeword": """
          select ok query_id, case when ok%20<=16 then payload_hex end payload_hex,
            case when ok%20<=16 then (ok%20)::INT else -1 end byte_errors from ledger""",
        "lookup": f"""
          picked as (
            select ok, asset_id from (
              select s.ok, r.asset_id, row_number() over (partition by s.ok order by
                coalesce(s.ok%4=3 and s.account_id=r.account_id, false) desc, r.created_at desc, r.asset_id) rn
              from ledger s join reregistered r on s.payload_hex=r.payload_hex
              where (s.ok%4=0 and s.ok%20<=16) or s.ok%4=3) where rn=1),
          seen as (
            select s.query_id ok, min((bit_count(xor(s.q, r.t))::INT, r.asset_id)) best
            from (select query_id, {_u64('phash')} q from suspects where query_id%4=1) s,
                 (select asset_id, {_u64('phash')} t from reregistered) r
            where bit_count(xor(s.q, r.t))<=10 group by s.query_id),
          word as (
            select l.ok, case when l.ok%4=1 then substr(sha256('stray|'||l.ok),1,32)
                            when l.ok%4=3 or (l.ok%4=0 and l.ok%20<=16) then l.payload_hex end payload_hex,
              coalesce(p.asset_id, s.best[2]) asset_id
            from ledger l left join picked p on p.ok=l.ok left join seen s on s.ok=l.ok)
          select w.ok::VARCHAR image_id,
            case when w.asset_id is not null then 'MATCH_FOUND' when w.payload_hex is not null
              then 'PAYLOAD_EXTRACTED' else 'NO_PAYLOAD' end status,
            w.asset_id, w.payload_hex,
            case when w.asset_id is not null then w.payload_hex=r.payload_hex end payload_match,
            coalesce(bit_count(xor(('0x'||q.phash)::UBIGINT, ('0x'||r.phash)::UBIGINT))::INT, -1) phash_distance,
            r.account_id match_account, case when w.asset_id is not null then true end within_threshold,
            case when w.payload_hex is not null then
                'OK (corrected '||(case when w.ok%4=0 then w.ok%20 else 0 end)||' byte errors)'
              when w.ok%4=2 then 'DECODE_FAILED:insufficient_bits'
              else 'DECODE_FAILED:no_registered_payload' end extraction_status
          from word w join suspects q on q.query_id=w.ok left join reregistered r on r.asset_id=w.asset_id""",
        "verify": f"""
          select s.ok::VARCHAR image_id, s.claimed asset_id,
            l.asset_id is not null and s.ok%4<>1 and s.ok%4<>2 and s.own and (s.ok%4<>0 or s.ok%20<=16) verified,
            case when l.asset_id is null then 'ASSET_NOT_FOUND'
              when s.ok%4=2 then 'NO_PAYLOAD'
              when s.ok%4=0 and s.ok%20>16 then 'NO_PAYLOAD'
              when s.ok%4=0 and s.own then 'OK (corrected '||(s.ok%20)||' byte errors)'
              when s.ok%4=0 and s.ok%20>0 then 'NO_PAYLOAD'
              else 'OK (corrected 0 byte errors)' end status,
            coalesce({_hamming('s.dhash', 'l.dhash')}, -1) dhash_distance
          from (select ok, dhash, case ok%5 when 0 then 'missing-'||ok
                  when 1 then (select asset_id from ledger where ok=3) else asset_id end claimed,
                  ok%5>1 or (ok%5=1 and ok=3) own from ledger) s
          left join ledger l on l.asset_id=s.claimed""",
        "extract_and_lookup": """
          select vec_id::VARCHAR image_id, 'MATCH_FOUND' status, l.asset_id, l.payload_hex,
            true payload_match
          from embeddings join ledger l on l.ok=vec_id""",
        "embed_and_register": """
          select l.payload_hex, l.account_id, (128 + 8*(vec_id%3))::INT image_width,
            128::INT image_height, ((128 + 8*(vec_id%3))*384)::BIGINT file_size_bytes,
            true clear, true verified
          from embeddings join ledger l on l.ok=vec_id""",
        # --- blocks
        "image_blocks": """
          select image_id, b::INT block_idx,
            list_transform(range(64), lambda p:
              v[((8*(b//(width//8)) + p//8)*width + 8*(b%(width//8)) + p%8 + 1)::BIGINT]) yy,
            list_sum(yy)::BIGINT total, yy[1]::BIGINT first_cell, yy[64]::BIGINT last_cell,
            list_sum(list_transform(range(64), lambda p: p*yy[p+1]))::BIGINT moment
          from luma, range(100) t(b)""",
        "block_dct": """
          select image_id, block_idx, round(energy, 4)+0.0 energy, round(c0, 4)+0.0 c0,
            round(c1, 4)+0.0 c1, round(c2, 4)+0.0 c2, round(c3, 4)+0.0 c3, round(sync, 4)+0.0 sync from features""",
        "block_idct": """
          select image_id, block_idx, list_sum(y)::BIGINT total,
            list_sum(list_transform(range(64), lambda p: p*y[p+1]))::BIGINT moment from blocks""",
        "embed_bits": """
          marked as (
            select f.image_id, f.block_idx, f.sync, 20.0*(1.0+f.energy/100.0) delta,
              [f.c0, f.c1, f.c2, f.c3] c,
              ('0x'||substr(w.codeword, least(greatest(f.block_idx-3, 1), 96)::INT, 1))::INT nib
            from features f join (select ok::VARCHAR image_id, codeword from codewords) w
              on w.image_id=f.image_id),
          stepped as (
            select *, list_transform(range(4), lambda n: round_even(c[n+1]/delta, 0)::BIGINT) q,
              round_even(sync/20.0, 0)::BIGINT sq from marked),
          moved as (
            select *, list_transform(range(4), lambda n:
              case when block_idx between 4 and 99
                then (q[n+1] + case when abs(q[n+1]%2)<>((nib >> (3-n)::INT) & 1) then 1 else 0 end)*delta
                else c[n+1] end) z from stepped)
          select image_id, block_idx, round(z[1],4)+0.0 c0, round(z[2],4)+0.0 c1, round(z[3],4)+0.0 c2,
            round(z[4],4)+0.0 c3, round(case when block_idx<4 then
              (sq + case when sq%2=0 then 1 else 0 end)*20.0 else sync end,4)+0.0 sync
          from moved""",
        "sync_gain": "select image_id, round(gain, 6) gain from gains",
        "extract_codewords": """
          select image_id, string_agg(substr('0123456789abcdef', (nib+1)::INT, 1), '' order by block_idx) codeword,
            'READ' status
          from (select f.image_id, block_idx,
              8*abs(round_even(c0/s,0)::BIGINT%2)+4*abs(round_even(c1/s,0)::BIGINT%2)
              +2*abs(round_even(c2/s,0)::BIGINT%2)+abs(round_even(c3/s,0)::BIGINT%2) nib
            from (select f.*, 20.0*(1.0+energy/100.0)*gain s from features f join gains g on g.image_id=f.image_id) f
            where block_idx between 4 and 99)
          group by image_id""",
        "psnr": """
          select image_id, round(20*log10(255/sqrt(sum(list_sum(list_transform(range(64), lambda p:
            pow((block_idx+p)%3, 2))))/sum(64))), 6) psnr_db from blocks group by image_id""",
        "downsample": """
          select image_id, n cell, round(list_sum(list_transform(range((16*width//8)::BIGINT), lambda j:
              v[((16*(n//8) + j//(width//8))*width + (width//8)*(n%8) + j%(width//8) + 1)::BIGINT]))
              / (2.0*width), 6) mean
          from luma, (select range::INT n from range(64))""",
        # --- hashes
        "ahash": f"""
          select vec_id, {_hash_bits('e[#+1] > list_sum(e)/64.0')} ahash from vectors""",
        "dhash": f"""
          select vec_id, {_hash_bits('e[((#+#//8+1)%64)+1] > e[((#+#//8)%64)+1]')} dhash from vectors""",
        "whash": f"""
          select vec_id, {_hash_bits('e[#+1] > med')} whash
          from (select *, list_median(e) med from vectors)""",
        "phash": f"""
          low as (
            select vec_id, list_transform(range(64), lambda n:
              list_inner_product(rows32[n//8+1], list_transform(range(32), lambda r:
                list_inner_product(rows32[n%8+1], g[(32*r+1):(32*r+32)])))) c
            from cells32, basis32),
          cut as (
            select vec_id, c, list_median(list_transform(list_filter(range(64), lambda n: n>=8 and n%8<>0),
              lambda n: c[n+1])) med from low)
          select vec_id, {_hash_bits('c[#+1] > med')} phash from cut""",
        "hash_images": f"""
          low as (
            select image_id, list_transform(range(64), lambda n:
              list_inner_product(rows32[n//8+1], list_transform(range(32), lambda r:
                list_inner_product(rows32[n%8+1], list_transform(g[(32*r+1):(32*r+32)], lambda x: x::DOUBLE))))) c
            from image_grids, basis32),
          cut as (
            select image_id, c, list_median(list_transform(list_filter(range(64), lambda n: n>=8 and n%8<>0),
              lambda n: c[n+1])) med from low),
          nine as (
            select image_id, e, list_sum(e) total, list_median(e) mid, list_transform(range(72), lambda i:
              list_sum(list_transform(range(4), lambda j: nines[(4*(i//9)+j+1)::BIGINT][(i%9+1)::BIGINT]))) d
            from eights)
          select n.image_id, {_hash_bits('c[#+1] > med')} phash,
            {_hash_bits('d[(#+#//8+1)+1] > d[(#+#//8)+1]')} dhash,
            {_hash_bits('64*e[#+1] > total')} ahash, {_hash_bits('e[#+1] > mid')} whash
          from nine n join cut on cut.image_id=n.image_id""",
        # --- audits
        "audit_chain": """
          select account_id||'-t' account_id, count(*) mismatches from ledger
          where ok%97=0 group by account_id""",
        "chain_mismatches": "select asset_id, account_id||'-t' account_id from ledger where ok%97=0",
        "audit_sealed": """
          select strftime(creation_timestamp, '%Y-%m') created_month, 'new' status, count(*)::bigint n_rows,
            count_if(ok%97=0)::bigint mismatches
          from ledger where ok%2<>0 group by 1""",
        "rate_limit_audit": """
          select event_id, key, strftime(window_start, '%Y-%m-%dT%H:%M:%S.%f') window_start, rn>4 over_limit from (
            select event_id, event_type key, date_trunc('hour', ts) window_start,
              row_number() over (partition by event_type, date_trunc('hour', ts) order by ts, event_id) rn
            from events)""",
        "challenge_audit": """
          select event_id, malformed, expired, mac_valid, replayed, uses,
            case when malformed then 'MALFORMED' when expired then 'EXPIRED'
              when not mac_valid then 'BAD_MAC' when replayed then 'REPLAYED' else 'OK' end outcome
          from (
            select event_id, event_id%101=0 malformed,
              event_id%101<>0 and epoch_us(seen_at)//1000000 > "exp" expired,
              event_id%101<>0 and mac=right_mac mac_valid,
              event_id%101<>0 and row_number() over (partition by account_id, nonce, event_id%101=0
                order by seen_at, event_id) > 1 replayed,
              coalesce(case when event_id%101<>0 then count(*) over
                (partition by account_id, nonce, event_id%101=0) end, -1) uses
            from challenges)""",
        "commit_batch": f"""
          made as (select * from (values {_commitments()}) t(k, v, r, c))
          select ok, case ok%10 when 0 then 'VALUE_RANGE' when 1 then 'RANDOMNESS_RANGE' end commitment_error,
            case when ok%10>1 then v end zkp_opening_value,
            case when ok%10>1 then r end zkp_opening_randomness,
            case when ok%10>1 then c end zkp_commitment_hex
          from ledger join made on ok%{len(OPENINGS)}=k""",
        "verify_commitments": "select ok, ok%7<>0 and ok%7<>2 opening_valid from ledger",
        "verify_commitments_grouped": """
          select device_signature, count(*) n_rows,
            sum(case when ok%7=2 then 1 else 0 end)::BIGINT n_bad,
            device_signature not in ('dev-0','dev-2') group_valid from ledger group by device_signature""",
        "find_bad_openings": "select ok, device_signature from ledger where ok%7=0 or ok%7=2",
        # --- streams
        "rate_limit_windows": """
          select key, strftime(window_start, '%Y-%m-%dT%H:%M:%S.%f') window_start, n requests,
            greatest(n-4, 0) over_limit
          from (select event_type key, date_trunc('hour', ts) window_start, count(*) n from events group by all),
               (select max(ts) m from events)
          where window_start + interval 1 hour <= m - interval 1 minute""",
        "replay_first_uses": """
          uses as (select account_id, nonce, epoch_us(seen_at) us,
              row_number() over (partition by account_id, nonce order by seen_at, event_id) k
            from challenges where event_id%101<>0),
          walk as (select account_id, nonce, k, us as last, true fine from uses where k=1
            union all
            select u.account_id, u.nonce, u.k,
              case when u.us-w.last>=600000000 then u.us else w.last end, u.us-w.last>=600000000
            from walk w join uses u on u.account_id=w.account_id and u.nonce=w.nonce and u.k=w.k+1)
          select account_id, nonce, count(*) passed from walk where fine group by 1, 2""",
        "registered_claims": f"""
          select {_uuid("digest")} asset_id, payload_hex, chain_of_custody_hash
          from (select *, sha256(concat_ws('|', payload_hex, phash, dhash, ahash, whash, account_id)) digest
                from ledger)""",
        "matched_suspects": """
          select ok::VARCHAR image_id, case when ok%20<=16 then 'MATCH_FOUND' else 'NO_PAYLOAD' end status,
            case when ok%20<=16 then asset_id end asset_id from ledger""",
    }
    bodies["image_blocks"] = (
        "select image_id, block_idx, total, first_cell, last_cell, moment from ("
        + bodies["image_blocks"]
        + ")"
    )
    # other ways to the same rows
    for name in ("radius_join", "match_codeword", "lookup"):
        bodies[f"{name}_indexed"] = bodies[name]
    return {name: _assemble(body) for name, body in bodies.items()}

